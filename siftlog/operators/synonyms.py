"""Synonym learning from word contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fixed import BASE_SYNONYMS, STOPWORDS
from ..functions.text import learner_tokens
from ..runtime import stage

REACH = 3
OVERLAP = 0.6


def token_sequences(messages: DataFrame, message: str = "message") -> DataFrame:
    """Distinct token sequences with their number of messages.  Numbers are not tokens,
    so the lines of one template usually collapse into one row."""
    return (messages.select(learner_tokens(message).alias("tokens")).groupBy("tokens")
            .agg(F.count(F.lit(1)).alias("w")).filter(F.size("tokens") > 0))


def word_frequency(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.explode("tokens").alias("word"), "w").groupBy("word").agg(F.sum("w").alias("freq"))


def word_cooccurrence(sequences: DataFrame) -> DataFrame:
    """``word, other, cnt``: ordered pairs at most three positions apart.

    Neighbours are sliced out of each sequence; there is no position self-join.
    """
    at = sequences.select("w", "tokens", F.posexplode("tokens").alias("i", "word"))
    near = F.slice("tokens", F.greatest(F.col("i") - REACH + 1, F.lit(1)),
                   F.col("i") + REACH + 1 - F.greatest(F.col("i") - REACH, F.lit(0)))
    return (at.select("w", "word", F.explode(near).alias("other")).filter(F.col("word") != F.col("other"))
            .groupBy("word", "other").agg(F.sum("w").alias("cnt")))


def _letters(word: Column) -> Column:
    return F.array_distinct(F.split(word, ""))


def learn_synonyms(messages: DataFrame, message: str = "message", min_cooc: int | None = None,
                   threshold: float = 0.7) -> DataFrame:
    """``word, replacement, similarity`` for rare spellings of commoner, longer words.

    shared = Σ min(context counts) must reach ``threshold`` of the rare word's
    context total, so a partner must occur in every set of contexts heavier
    than 1 − threshold of it.  Only such a set, taken from the least common
    context words, is joined; the rest of the contexts is read for true
    candidates only.
    """
    sequences = stage(token_sequences(messages, message))
    if min_cooc is None:
        min_cooc = max(2, (messages.count()) // 500)
    freq = word_frequency(sequences)
    cooc = stage(word_cooccurrence(sequences))
    fanout = cooc.groupBy("other").agg(F.count(F.lit(1)).alias("fan"))
    ctx = cooc.join(fanout, "other")

    # the lightest contexts by fan-out whose weight exceeds (1 - threshold) of the total
    rare_ok = ~F.col("word").isin(*BASE_SYNONYMS, *STOPWORDS)
    order = W.partitionBy("word").orderBy("fan", "other")
    weighed = (ctx.filter(rare_ok)
               .withColumn("total", F.sum("cnt").over(W.partitionBy("word")))
               .withColumn("before", F.coalesce(F.sum("cnt").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    slack = F.least((1.0 - threshold) * F.col("total"), F.col("total") - min_cooc)
    # at least min_cooc must be shared too, which may allow an even shorter prefix
    prefix = weighed.filter((F.col("total") >= min_cooc) & (F.col("before") <= slack + 1e-9)).select("word", "other")

    # a partner shares min_cooc contexts, so it has at least that many itself
    sized = (freq.join(cooc.groupBy("word").agg(F.sum("cnt").alias("_t")).filter(F.col("_t") >= min_cooc).select("word"), "word"))
    rare_side = prefix.join(sized, "word").withColumnRenamed("word", "rare").withColumnRenamed("freq", "rare_freq")
    common_side = (cooc.select("word", "other").join(sized, "word")
                   .withColumnRenamed("word", "common").withColumnRenamed("freq", "common_freq"))
    r, c = F.col("rare"), F.col("common")
    overlap = F.size(F.array_intersect(_letters(r), _letters(c))) / F.size(_letters(r))
    pairs = stage(rare_side.join(common_side, "other")
                  .filter((F.char_length(c) > F.char_length(r)) & (F.col("common_freq") >= F.col("rare_freq"))
                          & (overlap >= OVERLAP))
                  .select("rare", "common").distinct())
    a = cooc.select(F.col("word").alias("rare"), "other", F.col("cnt").alias("rc"))
    b = cooc.select(F.col("word").alias("common"), "other", F.col("cnt").alias("cc"))
    shared = (pairs.join(a, "rare").join(b, ["common", "other"])
              .groupBy("rare", "common").agg(F.sum(F.least("rc", "cc")).alias("shared")))
    totals = cooc.groupBy(F.col("word").alias("rare")).agg(F.sum("cnt").alias("total"))
    sims = (shared.join(totals, "rare").withColumn("similarity", F.col("shared") / F.col("total"))
            .filter((F.col("shared") >= min_cooc) & (F.col("similarity") >= threshold)))
    best = sims.groupBy("rare").agg(F.min_by(F.struct("common", "similarity"),
                                             F.struct(-F.col("similarity"), F.col("common"))).alias("b"))
    return best.select(F.col("rare").alias("word"), F.col("b.common").alias("replacement"), F.col("b.similarity").alias("similarity"))


def merged_dictionary(learned: DataFrame) -> DataFrame:
    """Base dictionary with the learned words laid over it."""
    spark = learned.sparkSession
    base = spark.createDataFrame(list(BASE_SYNONYMS.items()), "word string, replacement string")
    return (base.join(learned, "word", "left_anti").select("word", "replacement")
            .unionByName(learned.select("word", "replacement")))


def corpus_fingerprint(messages: DataFrame, message: str = "message") -> DataFrame:
    """Order-free fingerprint of all messages: their number and a sum of hashes."""
    return messages.agg(F.count(F.lit(1)).alias("n"),
                        F.sum(F.xxhash64(message).cast("decimal(38,0)")).cast("string").alias("h")).select(
        F.concat_ws(":", F.col("n").cast("string"), F.coalesce("h", F.lit("0"))).alias("fingerprint"))
