"""From raw documents to token ids: quality, near copies, repeated passages, test items, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and gives it to the next stage.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlog.llm import bpe, ordinal
from siftlog.llm.contamination import decontaminated
from siftlog.llm.jaccard import jaccard_groups
from siftlog.llm.suffixes import without_repeats
from siftlog.runtime import lookup_join, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the classifier accepts; those without a word go."""
    labels = ordinal.label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = ordinal.score(docs, ordinal.train(docs, labels, 3), 2)
    return scored.filter("accepted").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 80 %), the one with the smallest id; rows with a null id stay."""
    groups = stage(jaccard_groups(docs, width=5, percent=80))
    gone = stage(groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    kept = lookup_join(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)
    again = stage(groups.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    single = lookup_join(kept, again, ["doc_id"], "left_anti").select(*docs.columns)
    return single.unionByName(lookup_join(kept, again, ["doc_id"]).select(*docs.columns).dropDuplicates(["doc_id"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more are cut out where they occur again; a document of which nothing is left goes."""
    return without_repeats(docs)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; the ids are staged, so that a task has one Python worker and not two."""
    ids = stage(bpe.encoded(docs.select("doc_id", "text"), TOKENIZER).drop("text"))
    return bpe.digests(bpe.decoded(ids, TOKENIZER))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", test_items), ("BPE encoding and decoding", encoding)]
ORACLE_SQL = None             # the stages are not expressible in SQL; tests/llm/test_pipeline.py compares with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs


Q = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
