"""One query per operator, with production parameters over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, language, ordinal, sqltext, token_files
from .contamination import leaks
from .jaccard import jaccard_groups
from .licenses import scan_licenses
from .merkle import document_manifest
from .nearest import nearest
from .spelling import spelling_groups
from .suffixes import repeated_spans
from .urls import judge_pages
from .vectors import vector_groups

Q, SQL = {}, {"op11_merkle_manifest": sqltext.MERKLE, "op12_spelling_variants": sqltext.SPELLING}


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_benchmark_decontamination(spark, sf):
    """Every (document, test item) pair whose alignment reaches the score."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_suffix_array_dedup(spark, sf):
    """One row per document: the word spans that repeat an earlier passage of 50 words or more."""
    docs = table(spark, sf, "documents")
    spans = repeated_spans(docs).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_repeated"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (docs.select("doc_id").join(spans, "doc_id", "left")
            .select("doc_id", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"), F.coalesce("spans", none).alias("spans")))


def op3_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    dictionaries = language.train(docs.filter(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "held_out", "text"), dictionaries).drop("text")


def op4_url_filter(spark, sf):
    return judge_pages(table(spark, sf, "pages"))


def op5_quality_classifier(spark, sf):
    """Expected grade and P(good) of every document."""
    docs = table(spark, sf, "documents")
    model = ordinal.train(docs, ordinal.label_grades(table(spark, sf, "labels")), 3)
    return ordinal.score(docs.select("doc_id", "text"), model, 2).select("doc_id", "expected_grade", "p_good", "accepted")


def op6_bpe_encoding(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.digests(bpe.decoded(bpe.encoded(docs, path).drop("text"), path))


def op7_license_scan(spark, sf):
    return scan_licenses(table(spark, sf, "documents"), across_lines=True)


def op8_embedding_near_dedup(spark, sf):
    return vector_groups(table(spark, sf, "embeddings"))


def op9_token_files(spark, sf):
    manifest = token_files.write_token_files(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), token_files.token_folder(spark))
    return token_files.read_token_files(manifest)


def op10_ngram_jaccard_join(spark, sf):
    return jaccard_groups(table(spark, sf, "documents"))


def op11_merkle_manifest(spark, sf):
    return document_manifest(table(spark, sf, "documents"))


def op12_spelling_variants(spark, sf):
    return spelling_groups(table(spark, sf, "documents"))


def op13_nearest_neighbours(spark, sf):
    return nearest(table(spark, sf, "embeddings"))


for _f in (op1_benchmark_decontamination, op2_suffix_array_dedup, op3_language_id, op4_url_filter, op5_quality_classifier,
           op6_bpe_encoding, op7_license_scan, op8_embedding_near_dedup, op9_token_files, op10_ngram_jaccard_join,
           op11_merkle_manifest, op12_spelling_variants, op13_nearest_neighbours):
    Q[_f.__name__] = _f
