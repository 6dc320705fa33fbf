"""TF-IDF over normalised messages, and template vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.base import extract_all
from ..functions.features import feature_vector
from ..functions.fixed import TOKEN_PATTERN
from ..functions.text import normalize_message, normalize_token, text_terms
from ..functions.vectors import combine_blocks
from ..runtime import evaluate_once, fits, lookup_join

LITERAL_SYNONYMS = 5_000


def with_normalized(df: DataFrame, synonyms: DataFrame | None = None, message: str = "message",
                    key: str | None = None, upper_only: bool = False) -> DataFrame:
    """Add ``norm``.  ``synonyms`` (word, replacement) is merged over the base dictionary.

    A learned dictionary of checked size becomes one constant map; a larger one
    is joined to the distinct tokens of the texts.
    """
    if synonyms is None:
        return df.withColumn("norm", normalize_message(message, upper_only=upper_only))
    if fits(synonyms, LITERAL_SYNONYMS):
        table = {r[0]: r[1] for r in synonyms.select("word", "replacement").collect()}
        return df.withColumn("norm", normalize_message(message, table, upper_only))
    texts = df.select(message).distinct()
    tokens = texts.select(message, F.posexplode(extract_all(message, TOKEN_PATTERN)).alias("pos", "token"))
    # every word a token may need: itself, its camel-case parts, its letter part
    parts = F.concat(
        F.array(F.lower("token")),
        F.split(F.lower(F.regexp_replace(F.regexp_replace("token", "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")), " +"),
        F.array(F.regexp_extract(F.lower("token"), r"^([a-z]+)\d+$", 1)))
    words = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(parts)).alias("word"))
    found = lookup_join(words, synonyms.select("word", "replacement"), ["word"])
    maps = found.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("word", "replacement"))).alias("m"))
    mapped = lookup_join(tokens, maps, ["token"], "left").withColumn(
        "t", normalize_token(F.col("token"), F.coalesce("m", F.create_map().cast("map<string,string>")), upper_only))
    rows = mapped.groupBy(message).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("ts"))
    norm = rows.select(message, F.array_join(F.transform("ts", lambda r: r.getField("t")), " ").alias("norm"))
    return (lookup_join(df, norm, [message], "left").withColumn("norm", F.coalesce("norm", F.lit(""))))


# fixed values: the defaults decide results
@dataclass(frozen=True)
class TextModel:
    """``size`` terms of at least ``min_df`` lines (None: 2 from ten lines on, else 1); ``weight`` of the feature block."""

    size: int = 256
    weight: float = 0.4
    min_df: int | None = None


def fit_vocabulary(docs: DataFrame, model: TextModel = TextModel()) -> DataFrame:
    """``term, tf, df, idf, idx`` of the ``size`` most frequent terms.

    ``docs`` has one row per line with ``norm``.  Equal texts are counted
    first, so the terms of a text are produced once however often it repeats.
    """
    texts = docs.groupBy("norm").agg(F.count(F.lit(1)).alias("w"))
    n = docs.select(F.count(F.lit(1)).alias("n")).scalar()
    def mark(terms, tf: int, df: int):
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df")))

    # a text without a repeated term needs one row per term
    marks = F.when(F.size("terms") == F.size("once"), mark("once", 1, 1)).otherwise(F.concat(mark("terms", 1, 0), mark("once", 0, 1)))
    held = evaluate_once(evaluate_once(texts, terms=text_terms("norm")).select("w", "terms"), once=F.array_distinct("terms"))
    terms = (held.select("w", F.explode(marks).alias("m"))
             .groupBy("m.term").agg(F.sum(F.col("w") * F.col("m.tf")).alias("tf"), F.sum(F.col("w") * F.col("m.df")).alias("df")))
    min_df = F.when(n >= 10, F.lit(2)).otherwise(F.lit(1)) if model.min_df is None else F.lit(model.min_df)
    kept = terms.filter(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(model.size)
    # ``size`` rows at most from here on
    return (kept.withColumn("idx", F.row_number().over(W.orderBy(F.desc("tf"), "term")) - 1)
            .withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1.0))


def tfidf(docs: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Long form ``key, idx, term, weight``: (1 + ln tf) · idf, unit length per document."""
    # a document travels once, as its text; counts and norms are then worked out where its terms are
    hits = (docs.select(key, "norm").filter(F.col(key).isNotNull()).repartition(key)
            .select(key, F.explode(text_terms("norm")).alias("term"))
            .join(F.broadcast(vocabulary.select("term", "idx", "idf")), "term")      # ``size`` rows
            .groupBy(key, "idx", "term", "idf").agg(F.count(F.lit(1)).alias("k")))
    raw = hits.withColumn("raw", (1.0 + F.log("k")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))      # ``size`` rows of a key at most
    return raw.select(key, "idx", "term", (F.col("raw") / norm).alias("weight"))


def dense_text(docs: DataFrame, vocabulary: DataFrame, key: str, size: int) -> DataFrame:
    """``key, text_vec``: dense unit rows, zero rows for documents without known terms."""
    hits = tfidf(docs, vocabulary, key)
    sparse = hits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("m"))
    joined = docs.select(key).join(sparse, key, "left")
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    zeros = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.lit(0.0))
    return joined.select(key, F.when(F.col("m").isNull(), zeros).otherwise(dense).alias("text_vec"))


def embed_templates(templates: DataFrame, vocabulary: DataFrame, model: TextModel = TextModel(),
                    synonyms: DataFrame | None = None) -> DataFrame:
    """``template_id, vec``: text block and feature block of each representative."""
    reps = templates.select("template_id", "rep.level", "rep.service", "rep.message")
    docs = with_normalized(reps, synonyms)
    text = dense_text(docs.select("template_id", "norm"), vocabulary, "template_id", model.size)
    feats = reps.select("template_id", feature_vector("level", "service", "message").alias("feat_vec"))
    vec = combine_blocks("text_vec", "feat_vec", model.weight)
    return text.join(feats, "template_id").select("template_id", vec.cast("array<float>").alias("vec"))


def combine_with_features(templates: DataFrame, vectors: DataFrame,
                          text: DataFrame | None = None, text_weight: float = 0.15,
                          feature_weight: float = 0.25) -> DataFrame:
    """Sentence vectors of any encoder (``template_id, vec``), then text block, then features."""
    feats = templates.select("template_id", feature_vector("rep.level", "rep.service", "rep.message").alias("feat_vec"))
    out = vectors.select("template_id", F.col("vec").cast("array<double>").alias("v"))
    if text is not None:
        out = out.join(text, "template_id").withColumn("v", combine_blocks("v", "text_vec", text_weight))
    return (out.join(feats, "template_id")
            .select("template_id", combine_blocks("v", "feat_vec", feature_weight).cast("array<float>").alias("vec")))


def mean_vector(vec: Column, weight: Column | None = None) -> Column:
    """Component-wise (weighted) mean as an aggregate with map-side partials."""
    v = array_to_vector(vec.cast("array<double>"))
    mean = Summarizer.mean(v) if weight is None else Summarizer.mean(v, weight.cast("double"))
    return vector_to_array(mean)


def group_vectors(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Unit mean vector per key."""
    from ..functions.vectors import row_normalize

    return (vectors.groupBy(*keys).agg(mean_vector(F.col("vec")).alias("_m"))
            .select(*keys, row_normalize("_m").alias("vec")))
