"""Repeated passages by a sparse suffix array.

Only suffixes that start at minimisers are kept: the smallest 16-word gram of
every window of ``length`` words.  Two equal passages of ``length`` words have the
same minimiser, whatever stands around them.

1. The kept suffixes are sorted by a packed key of their first 16 words and
   neighbours compared; a suffix that shares them with no other is gone for good.
2. The others travel with their words, as far as a run of ``length`` words around
   the minimiser can reach.  They are sorted word by word, and so are the words before
   them, read backwards; neighbours are compared in both orders.  The
   words that neighbours have in common say how far a match extends to the right
   and to the left, and where both together reach ``length`` words, all but the
   first in the order (doc_id, position) are repeats.  Overlapping repeats join to one span.

Skew: a task settles its own suffixes first and sends only those that still hold
a run without an earlier equal of the task, with no more words than these runs have.  A gram that more than
``HOT_SUFFIXES`` texts share sends its open runs one by one, spread by their words, so equal runs
still meet and no bucket receives the whole gram.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import lookup_join, number_ordered, stage
from .exchange import PACKED, bucket_count, by_bucket, gather, packed, release, text_batches
from .words import Words, chunks, grams, mix, sliding

GRAM = 16
SUFFIX = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("local", "?")])
SPAN = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("end", "<i8")])
TOP = np.uint64(2 ** 64 - 1)
LOCAL = -1                    # bucket of records that a task has settled by itself
HOT_SUFFIXES = 100_000        # suffixes of one gram that a bucket may receive whole, about 70 MB
HELD_BYTES = 3 << 20          # suffixes that a task settles at once


def minimisers(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram values, which of them are minimisers, and the minimum of the window that starts at each word."""
    g, ok = grams(w, GRAM)
    g = np.where(ok, np.minimum(g, TOP - np.uint64(1)), TOP)
    width = length - GRAM + 1
    low = sliding(g, width, np.minimum)
    if not len(low):
        return g, np.zeros(len(g), bool), low
    # a gram is kept when it is the smallest of some window that holds it
    around = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return g, (sliding(around, width, np.maximum) == g) & ok, low


def context(length: int) -> np.dtype:
    """A suffix with its words: from ``length - GRAM`` before the minimiser to ``length`` after its begin.

    Runs of ``length`` words that begin ``low`` to ``high`` words before the minimiser are open; words that none of them holds are 0.
    """
    return np.dtype([("gram", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("low", "<i2"), ("high", "<i2"), ("hot", "?"),
                     ("words", "<u8", (2 * length - GRAM,))])


def _trim(rec: np.ndarray, length: int) -> np.ndarray:
    """Only the words that an open run holds stay."""
    place = np.arange(GRAM - length, length)
    rec["words"][(place < -rec["high"][:, None]) | (place >= length - rec["low"][:, None])] = 0
    return rec


def contexts(w: Words, doc_ids: np.ndarray, known: np.ndarray, hot: np.ndarray, length: int):
    """Suffix records of the minimisers whose gram is ``known``, in groups of bounded size."""
    g, kept, least = minimisers(w, length)
    whole = w.doc[length - 1:] == w.doc[:len(least)]
    anchors = np.flatnonzero(kept)
    anchors = anchors[np.isin(g[anchors], known)]
    back, around, kind = np.arange(length - GRAM + 1), np.arange(GRAM - length, length), context(length)
    step = max(1, HELD_BYTES // kind.itemsize)
    for p in (anchors[i:i + step] for i in range(0, len(anchors), step)):
        start = p[:, None] - back
        at = np.clip(start, 0, len(least) - 1)
        own = (start == at) & whole[at] & (least[at] == g[p][:, None])       # the runs whose minimum the anchor is lie together
        used = own.any(axis=1)
        p, own = p[used], own[used]
        rec = np.zeros(len(p), kind)
        rec["gram"], rec["doc"], rec["pos"] = g[p], doc_ids[w.doc[p]], p - w.first_word[w.doc[p]]
        rec["low"], rec["high"] = own.argmax(axis=1), length - GRAM - own[:, ::-1].argmax(axis=1)
        rec["hot"] = np.isin(rec["gram"], hot)
        rec["words"] = w.hash[np.clip(p[:, None] + around, 0, len(w.hash) - 1)]
        yield _trim(rec, length)


def ordered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows word by word, and how many first words each has in common with the one before."""
    rows = np.ascontiguousarray(words)
    order = np.argsort(rows.view(f"S{rows.shape[1] * 8}").ravel(), kind="stable")       # byte order is an order of words
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def classes(order: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """Rows with equal first ``n`` words get one number: they lie together in the order."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(common < n)])
    return out


def settled(rec: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records by (doc, pos), which runs of each are open, and which of these repeat an earlier one."""
    rec = rec[np.lexsort((rec["pos"], rec["doc"]))]
    back = np.arange(length - GRAM + 1)
    runs = (rec["low"][:, None] <= back) & (back <= rec["high"][:, None])
    again = np.zeros_like(runs)
    if len(rec) < 2:
        return rec, runs, again
    before, after = ordered(rec["words"][:, :length - GRAM][:, ::-1]), ordered(rec["words"][:, length - GRAM:])
    for k in back:
        at = np.flatnonzero(runs[:, k])
        if len(at) < 2:
            continue
        both = classes(*before, k)[at] * len(rec) + classes(*after, length - k)[at]
        _, first, group = np.unique(both, return_index=True, return_inverse=True)
        first = at[first[group]]
        again[at, k] = (rec["doc"][at] != rec["doc"][first]) | (rec["pos"][at] != rec["pos"][first])
    return rec, runs, again


def _spans(rec: np.ndarray, again: np.ndarray, length: int) -> np.ndarray:
    """Spans of words that the repeated runs cover."""
    row, back = np.nonzero(again)
    d, p = rec["doc"][row], rec["pos"][row].astype(np.int64) - back
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + length)])) if len(d) else np.zeros(0, int)
    out = np.zeros(len(at), SPAN)
    out["doc_id"], out["start"] = d[at], p[at]
    out["end"] = p[np.append(at[1:], len(d)) - 1] + length if len(d) else 0
    return out


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end`` (words from 0, end exclusive): the words of each text that repeat an earlier passage.

    A word is covered when it lies in a run of ``length`` words that occurs
    before, in the order (doc_id, position); within one text too.  Words are runs
    of bytes other than ASCII white space, A-Z lower-cased.  Spans of one text do
    not touch each other.  Texts that are null, empty or shorter have no
    spans, rows with a null id are left out, rows with one id are read as texts of
    their own under that id, in which equal texts count as one.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    given = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = bucket_count(spark, chars / 6 * 0.06 * SUFFIX.itemsize)

    def suffixes(batches):
        def make(part):
            w = Words(part.column(1))
            g, kept, _ = minimisers(w, length)
            at = np.flatnonzero(kept)
            rec = np.zeros(len(at), SUFFIX)
            rec["gram"], rec["doc"] = g[at], part.column(0).to_numpy()[w.doc[at]]
            return rec

        def flush(rec):
            rec = rec[np.lexsort((rec["doc"], rec["gram"]))]
            rec["local"] = np.concatenate([[False], rec["gram"][1:] == rec["gram"][:-1]])
            known = rec["local"] | np.append(rec["local"][1:], False)          # both neighbours of an equal pair
            buckets = (rec["gram"] % np.uint64(few)).astype(np.int32)
            witness = rec.copy()
            witness["local"] = known
            send = ~rec["local"]
            yield packed(buckets[send], witness[send])
            if known.any():
                yield packed(np.full(int(known.sum()), LOCAL, np.int32), rec[known])

        yield from gather(batches, make, flush)

    first = stage(given.mapInArrow(suffixes, PACKED))

    def compare(rec):
        order = np.argsort(rec["gram"], kind="stable")
        rec = rec[order]
        same = rec["gram"][1:] == rec["gram"][:-1] if len(rec) else np.zeros(0, bool)
        hit = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(rec) else np.zeros(0, bool)
        out = rec[hit & ~rec["local"]]
        return pd.DataFrame({"doc_id": out["doc"], "gram": out["gram"].view(np.int64)})

    def unpack(batches):
        for batch in batches:
            rec = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), SUFFIX)
            yield pa.RecordBatch.from_arrays([pa.array(rec["doc"]), pa.array(rec["gram"].view(np.int64))], names=["doc_id", "gram"])

    kinds = "doc_id long, gram long"
    anchors = (by_bucket(first.filter(F.col("bucket") != LOCAL), SUFFIX, compare, kinds)
               .unionByName(first.filter(F.col("bucket") == LOCAL).select("payload").mapInArrow(unpack, kinds)))
    anchors = stage(anchors.distinct())
    hot = stage(anchors.groupBy("gram").count().filter(F.col("count") > HOT_SUFFIXES).select("gram", F.lit(True).alias("hot")))
    if hot.head(1):
        anchors = lookup_join(anchors, hot, ["gram"], "left")
    else:
        anchors = anchors.withColumn("hot", F.lit(None).cast("boolean"))
    # an id has no more grams than words
    anchors = stage(anchors.groupBy("doc_id").agg(F.collect_list("gram").alias("grams"), F.collect_list(F.when(F.col("hot"), F.col("gram"))).alias("hot")))
    kind = context(length)
    count = anchors.agg(F.sum(F.size("grams"))).first()[0] or 0
    many = bucket_count(spark, 2.0 * count * kind.itemsize)       # settling a bucket takes several times its size
    spread = np.multiply.accumulate(np.full(2 * length - GRAM, 0x9E3779B97F4A7C15, np.uint64))

    def send(rec):
        rec, runs, again = settled(np.concatenate(rec), length)
        spans = _spans(rec, again, length)
        if len(spans):
            yield packed(np.full(len(spans), LOCAL, np.int32), spans)
        runs &= ~again
        own = np.flatnonzero(runs.any(axis=1) & ~rec["hot"])
        far = rec[own]
        far["low"], far["high"] = runs[own].argmax(axis=1), length - GRAM - runs[own][:, ::-1].argmax(axis=1)
        yield packed((far["gram"] % np.uint64(many)).astype(np.int32), _trim(far, length))
        row, back = np.nonzero(runs & rec["hot"][:, None])
        for i in range(0, len(row), 8192):
            one = rec[row[i:i + 8192]]
            one["low"] = one["high"] = back[i:i + 8192]
            one = _trim(one, length)
            yield packed((mix((one["words"] * spread).sum(axis=1)) % np.uint64(many)).astype(np.int32), one)

    def travel(batches):
        held, size = [], 0
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                known, own_hot = (np.unique(part.column(c).flatten().to_numpy().view(np.uint64)) for c in (2, 3))
                for rec in contexts(Words(part.column(1)), part.column(0).to_numpy(), known, own_hot, length):
                    held.append(rec)
                    size += rec.nbytes
                    if size >= HELD_BYTES:
                        yield from send(held)
                        held, size = [], 0
        if held:
            yield from send(held)
        held = []
        release()

    second = stage(lookup_join(given, anchors, ["doc_id"]).select("doc_id", "text", "grams", "hot").mapInArrow(travel, PACKED))

    def extend(rec):
        rec, _, again = settled(rec, length)
        return pd.DataFrame(_spans(rec, again, length))

    def local(batches):
        for batch in batches:
            rec = np.frombuffer(b"".join(x.as_py() for x in batch.column(0)), SPAN)
            yield pa.RecordBatch.from_arrays([pa.array(rec[f]) for f in SPAN.names], names=list(SPAN.names))

    kinds = "doc_id long, start long, end long"
    pieces = (by_bucket(second.filter(F.col("bucket") != LOCAL), kind, extend, kinds)
              .unionByName(second.filter(F.col("bucket") == LOCAL).select("payload").mapInArrow(local, kinds)))
    return merged(pieces)


def merged(pieces: DataFrame) -> DataFrame:
    """Touching and overlapping spans of each id joined to one; an id has no more pieces than words."""
    sorted_ = F.array_sort(F.collect_list(F.struct("start", "end")))
    step = ("aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) -> "
            "if(size(a) > 0 and x.start <= a[size(a) - 1].end, "
            "concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))), "
            "concat(a, array(x))))")
    return pieces.groupBy("doc_id").agg(sorted_.alias("s")).select("doc_id", F.inline(F.expr(step)))


def cut_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the words of their spans (lists of start, end) and the white space after them."""
    out = []
    for a, b in chunks(texts):
        part = texts.slice(a, b - a)
        w = Words(part)
        for i, (text, own) in enumerate(zip(part, spans.slice(a, b - a).to_pylist())):
            if not own:
                out.append(text.as_py())
                continue
            raw, first, base = w.raw[w.at[i]:w.at[i + 1]].tobytes(), w.first_word[i], w.at[i]
            kept, at = [], 0
            for s in own:
                kept.append(raw[at:w.begin[first + s["start"]] - base])
                after = first + s["end"]
                at = w.begin[after] - base if after < w.first_word[i + 1] else len(raw)
            out.append(b"".join([*kept, raw[at:]]).decode())
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; a text of which nothing is left goes.

    All columns stay; ``n_chars``, where it exists, is that of the new text.
    Rows without repeats are returned unchanged, null and empty texts too.  Different texts of one id
    are cut each by its own spans, in the order of the id and of a hash of the text; equal texts of one id stay equal.
    """
    names, at = docs.columns, docs.columns.index("text")
    rows = docs.withColumn("_text", F.xxhash64("text")).withColumn("_id", F.col("doc_id").cast("long"))
    pairs = rows.filter(F.col("_id").isNotNull()).select("_id", "_text").distinct()
    once, ids = pairs.groupBy("_id").count().agg(F.sum("count"), F.count(F.lit(1))).first()
    if (once or 0) > ids:                                    # some id has several texts: each text gets a number in their order
        rows = lookup_join(rows, stage(number_ordered(pairs, [F.col("_id"), F.col("_text")], "_own")), ["_id", "_text"], "left")
    else:
        rows = rows.withColumn("_own", F.col("_id"))
    spans = repeated_spans(rows, length, id_col="_own").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = lookup_join(rows, stage(spans.withColumnRenamed("doc_id", "_own")), ["_own"], "left").select(*names, "_spans")

    def cut(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = cut_spans(columns[at], columns[-1])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        release()

    out = joined.mapInArrow(cut, joined.schema).filter(F.col("_spans").isNull() | (F.trim("text") != ""))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)
