"""N-gram Jaccard join by parity sketches.

Every distinct shingle of a text toggles one bit of a sketch, so the Hamming distance of two
sketches is a lower bound of the symmetric difference of the sets.  Texts are compared within size
bands; in a band the difference of a linked pair is at most ``d``, so of ``d + 1 + slack`` segments of a
wide sketch at least ``1 + slack`` agree.

1. Segments that several texts share are found by their hash.  A text without more than ``slack`` segments that
   could agree with another's is done.  All others keep the rarest of theirs and leave out as many as
   ``slack`` of the commonest (segments with at most one bit count as commonest): a linked pair still shares one.
2. Texts that share a kept segment are compared by a sketch of ``BITS_PER_DIFFERENCE * d`` bits, made with the sizes in the first
   pass, so that no text travels for it; only pairs whose Hamming distance is at most ``d`` are candidates.
3. The shingle sets of the groups that candidates form are verified exactly.

Skew: equal sets are one class before anything is compared.  A segment that many texts of one task run
hold goes to the texts at once and not to one bucket.  The sketches of a common segment are compared with
pivots, so near copies cost one pass, and in pairs of bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.cluster import connected_components
from ..runtime import lookup_join, stage
from .exchange import PACKED, bucket_count, gather, packed, release, text_batches
from .words import Words, chunks, grams, mix, rolling

SEGMENT_BITS = 1 << 20
BITS_PER_DIFFERENCE = 3       # bits of the sketch that is compared, for each unit of the bound
RUN_SETS = 64                 # sets of one segment in a task run from which on it is common, whatever the other runs hold
SKETCHES = 4096               # sketches of a segment that are compared at once
VERIFY_SHINGLES = 1_000_000   # shingles of one block of a verified group
KEY = np.dtype([("key", "<u8"), ("set", "<i8"), ("info", "<u4")])     # info: weak segments of the text, and the two flags
BACK, WEAK, COMMON = 1 << 31, 1 << 30, (1 << 31) - 1      # for the band before the own one; a segment with at most one bit; its rank if it is common
SHARED = "set long, back boolean, weak boolean, n_weak int, rank int, key long"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by (text, hash), and the text number of each."""
    w = Words(texts)
    g, ok = grams(w, width)
    h, doc = g[ok], w.doc[:len(g)][ok]
    few = np.flatnonzero((w.per_doc > 0) & (w.per_doc < width))       # the whole sequence is the one shingle
    if len(few):
        whole = [rolling(w.hash[w.first_word[i]:w.first_word[i + 1]], int(w.per_doc[i]))[0] + np.uint64(w.per_doc[i]) for i in few]
        h, doc = np.concatenate([h, mix(np.array(whole, np.uint64))]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, doc


def set_ids(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two independent 64-bit sums of each set."""
    n = np.bincount(doc, minlength=docs)
    ends = np.cumsum(n)

    def sums(x):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
        return (run[ends] - run[ends - n]).view(np.int64)

    return n, sums(mix(h)), sums(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def size_bands(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, difference bound d, segments m) of each band; partners lie in the same or the next band."""
    bands, low = [], 1
    while low <= largest:
        high = 100 * low // percent + 1                       # first size of the next band
        a = high - 1
        b = 100 * a // percent
        d = (a + b) * (100 - percent) // (100 + percent)
        bands.append((low, d, d + 1 + _slack(d)))
        low = high
    return bands


def _slack(d: int) -> int:
    return (d + 1) // 4 + 2


def segment_keys(h, doc, n, ids, bands) -> np.ndarray:
    """Key records of all texts, for the band of each text and the band before it."""
    lows = np.array([b[0] for b in bands])
    home = np.searchsorted(lows, n, side="right") - 1
    out = []
    for back in (0, 1):
        band = home - back
        ds = np.array([b[1] for b in bands])[np.maximum(band, 0)]
        ms = np.array([b[2] for b in bands])[np.maximum(band, 0)].astype(np.uint64)
        use = ((n > 0) & (band >= 0) & (ds > 0))[doc]         # d = 0 means equal sets, which are one class already
        if not use.any():
            continue
        x, dx = mix(h[use] + np.uint64(0x1234567)), doc[use]
        seg = ((x >> np.uint64(32)) * ms[dx]) >> np.uint64(32)
        bit = x & np.uint64(SEGMENT_BITS - 1)
        place = (seg << np.uint64(20)) | bit
        order = np.lexsort((place, dx))
        place, dx = place[order], dx[order]
        # a bit toggled an even number of times is zero
        start = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (dx[1:] != dx[:-1])]))
        odd = np.diff(np.append(start, len(place))) % 2 == 1
        place, dx = place[start][odd], dx[start][odd]
        base = np.concatenate([[0], np.cumsum(ms.astype(np.int64) * ((band >= 0) & (ds > 0) & (n > 0)))])
        total = int(base[-1])
        slot = base[dx] + (place >> np.uint64(20)).astype(np.int64)
        bits = np.bincount(slot, minlength=total)
        key = np.zeros(total, np.uint64)
        at = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, int)
        if len(at):
            key[slot[at]] = np.bitwise_xor.reduceat(mix(place + np.uint64(1)), at)
        owner = np.repeat(np.arange(len(n)), np.diff(base))
        weak = bits <= 1
        slack = np.array([_slack(b[1]) for b in bands])[np.maximum(band, 0)]
        n_weak = np.bincount(owner, weights=weak, minlength=len(n)).astype(np.int64)
        keep = ~weak | (n_weak > slack)[owner]
        number = np.arange(total, dtype=np.int64) - base[owner]
        salt = mix((band[owner].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64) + np.uint64(77))
        rec = np.empty(int(keep.sum()), KEY)
        rec["key"] = mix(key[keep] ^ salt[keep])
        rec["set"] = ids[owner[keep]]
        rec["info"] = n_weak[owner[keep]] | np.where(weak[keep], WEAK, 0) | (BACK if back else 0)
        out.append(rec)
    return np.concatenate(out) if out else np.zeros(0, KEY)


def by_segment(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct records in the order of their segments, the number of each one's segment, and the records of each segment."""
    rec = rec[np.lexsort((rec["set"], rec["key"]))]
    key, own = rec["key"], rec["set"]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(rec)]
    rec = rec[new | np.concatenate([[True], own[1:] != own[:-1]])[:len(rec)]]
    at = np.cumsum(np.concatenate([[True], rec["key"][1:] != rec["key"][:-1]])[:len(rec)]) - 1
    return rec, at, np.bincount(at)


def shared(rec: np.ndarray) -> pd.DataFrame:
    """Texts of the segments that more than one holds; rarer segments have a smaller ``rank``."""
    rec, at, texts = by_segment(rec)
    marked = np.zeros(len(texts), bool)
    marked[at[rec["info"] == COMMON]] = True
    # linked texts meet in the own band of one of them
    home = np.bincount(at, weights=(rec["info"] & BACK) == 0, minlength=len(texts)) > 0
    rank = np.where(marked, COMMON, np.where(home, texts, 0))[at]
    out = (rank > 1) & (rec["info"] != COMMON)
    return memberships(rec[out], rank[out])


def memberships(rec: np.ndarray, rank) -> pd.DataFrame:
    info = rec["info"].astype(np.int64)
    return pd.DataFrame({"set": rec["set"], "back": (info & BACK) > 0, "weak": (info & WEAK) > 0, "n_weak": (info & (WEAK - 1)).astype(np.int32),
                         "rank": np.broadcast_to(np.int32(rank) if np.isscalar(rank) else rank.astype(np.int32), len(rec)), "key": rec["key"].view(np.int64)})


def compact_sketches(h: np.ndarray, doc: np.ndarray, ds: np.ndarray) -> list[bytes]:
    """Parity sketch of each set for its bound of ``ds``; empty where that is 0."""
    bits = 64 * -(-BITS_PER_DIFFERENCE * ds.astype(np.int64) // 64)
    ends = np.cumsum(bits)
    use = (ds > 0)[doc]
    h, doc = h[use], doc[use]
    place = ((mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * bits[doc].astype(np.uint64)) >> np.uint64(32)
    odd = np.bincount((ends - bits)[doc] + place.astype(np.int64), minlength=int(ends[-1]) if len(ends) else 0) & 1
    raw = np.packbits(odd.astype(np.uint8)).tobytes()
    return [raw[(e - m) // 8:e // 8] for e, m in zip(ends.tolist(), bits.tolist())]


def band_bounds(n: np.ndarray, percent: int, back: int) -> np.ndarray:
    """Difference bound of the band of each size, or of the band before it (``back`` = 1); 0 where there is none."""
    bands = size_bands(percent, int(n.max(initial=0)))
    band = np.searchsorted([b[0] for b in bands], n, side="right") - 1 - back
    return np.where(band >= 0, np.array([b[1] for b in bands] + [0])[np.maximum(band, 0)], 0)


def within_bound(sets: np.ndarray, sketches: np.ndarray, group: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of equal ``group`` (sorted) whose sketches differ in at most ``d`` bits; of a large group spanning ones."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(size <= RUN_SETS, size)
    for step in range(1, min(int(size.max(initial=1)), RUN_SETS)):
        a = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        for k in range(0, len(a), 20_000):
            p = a[k:k + 20_000]
            p = p[np.bitwise_count(sketches[p] ^ sketches[p + step]).sum(1) <= d]
            src.append(sets[p + step])
            dst.append(sets[p])
    for b, e in zip(first[size > RUN_SETS], (first + size)[size > RUN_SETS]):
        own, label, done = sketches[b:e], np.arange(e - b), np.zeros(e - b, bool)
        while True:                                          # as in ``linked``
            left = np.flatnonzero(~done & (label != np.bincount(label).argmax()))
            if not len(left):
                break
            done[left[0]] = True
            tied = np.unique(label[np.bitwise_count(own ^ own[left[0]]).sum(1) <= d])
            label[np.isin(label, tied)] = tied[0]
        moved = np.flatnonzero(label != np.arange(e - b))
        src.append(sets[b + moved])
        dst.append(sets[b + label[moved]])
    return np.concatenate(src), np.concatenate(dst)


def linked(ids: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, group: np.ndarray, percent: int) -> pd.DataFrame:
    """Spanning edges of the true links among texts of the same group.

    A pivot text is compared with all others through an index of the shingles.
    Texts of one component need no further comparison with each other, so only
    texts outside the largest component become pivots.
    """
    doc = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(shingles, kind="stable")
    s, d = shingles[order], doc[order]
    start = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    low = np.flatnonzero(start)
    high = np.append(low[1:], len(s))
    run = np.empty(len(s), np.int64)
    run[order] = np.cumsum(start) - 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    src, dst = [], []
    by_group = np.argsort(group, kind="stable")
    for members in np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1):
        if len(members) < 2:
            continue
        local = np.full(len(ids), -1)
        local[members] = np.arange(len(members))
        label = np.arange(len(members))
        done = np.zeros(len(members), bool)
        n = sizes[members]
        while True:
            largest = np.bincount(label).argmax()
            left = np.flatnonzero(~done & (label != largest))
            if not len(left):
                break
            p = left[0]
            done[p] = True
            r = run[begin[members[p]]:begin[members[p]] + n[p]]
            lens = high[r] - low[r]
            at = np.repeat(low[r] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            other = local[d[at]]
            both = np.bincount(other[other >= 0], minlength=len(members))
            hit = np.flatnonzero(100 * both >= percent * (n + n[p] - both))
            tied = np.unique(label[hit])
            if len(tied) > 1:
                label[np.isin(label, tied)] = tied[0]
        moved = np.flatnonzero(label != np.arange(len(members)))
        src.append(ids[members[moved]])
        dst.append(ids[members[label[moved]]])
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"src": np.concatenate(src) if src else none, "dst": np.concatenate(dst) if dst else none})


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                   verify_shingles: int = VERIFY_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  Two
    texts link when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of distinct
    ``width``-word shingles; shorter texts have one shingle, their whole word
    sequence.  The component is named by its smallest id.  A null, empty or blank text has
    an empty set and is alone; rows with equal ids stay rows; a null id never
    links and gets a null component.  Other columns are ignored, an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def signatures(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                h, doc = shingle_sets(part.column(1), width)
                n, h1, h2 = set_ids(h, doc, len(part))
                sketches = [pa.array(compact_sketches(h, doc, band_bounds(n, percent, back)), pa.binary()) for back in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), *sketches],
                                                 names=["doc_id", "n", "h1", "h2", "own", "before"])

    sig = stage(given.mapInArrow(signatures, "doc_id long, n long, h1 long, h2 long, own binary, before binary"))
    total, largest = sig.agg(F.sum("n"), F.max("n")).first()
    if not largest:
        return sig.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    classes = stage(sig.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")))
    bands = size_bands(percent, int(largest))
    buckets = bucket_count(spark, 10 * (100 - percent) / (100 + percent) * KEY.itemsize * float(total))     # segments of two bands for each shingle; settling takes several times a bucket

    def keys(batches):
        def make(part):
            present = part.column(0).is_valid()
            part = part.filter(present)
            h, doc = shingle_sets(part.column(1), width)
            n, ids, _ = set_ids(h, doc, len(part))
            _, once = np.unique(ids, return_index=True)       # equal sets are sent once
            use = np.zeros(len(n), bool)
            use[once] = True
            sel = use[doc] if len(doc) else np.zeros(0, bool)
            return segment_keys(h[sel], doc[sel], np.where(use, n, 0), ids, bands)

        def flush(rec):
            # a segment that many texts of the run hold is common: its bucket is told so, its texts do not go there
            rec, at, texts = by_segment(rec)
            common = (texts > RUN_SETS)[at]
            far, near = rec[~common], rec[common]
            if len(near):
                mark = near[np.concatenate([[True], near["key"][1:] != near["key"][:-1]])]
                mark["set"], mark["info"] = 0, COMMON
                far = np.concatenate([far, mark])
                yield packed(-1 - (near["set"].view(np.uint64) % np.uint64(buckets)).astype(np.int32), near)
            yield packed((far["key"] % np.uint64(buckets)).astype(np.int32), far)

        yield from gather(batches, make, flush)

    def settle(bucket: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rec = np.frombuffer(b"".join(bytes(p) for p in part["payload"]), KEY)
        out = memberships(rec, COMMON) if bucket[0] < 0 else shared(rec)
        del rec
        release()
        return out

    held = given.mapInArrow(keys, PACKED).groupBy("bucket").applyInPandas(settle, SHARED)
    edges = stage(_candidates(sig, classes, held, bands))
    groups = stage(connected_components(edges).select(F.col("node").alias("h1"), F.col("component").alias("grp")))
    # the texts to verify: one per class; a large group is cut into blocks, and every pair of blocks is one task's work
    found = stage(classes.join(groups, "h1"))
    sizes = found.groupBy("grp").agg(F.sum("n").alias("all")).filter(F.col("all") > verify_shingles)
    sizes = stage(sizes.select("grp", F.ceil(F.col("all") / verify_shingles).cast("int").alias("blocks")))
    found = lookup_join(found, sizes, ["grp"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    packs = max(1, int(4 * float(found.agg(F.sum("n")).first()[0] or 0) // verify_shingles))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    found = stage(found.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .select("rep", "grp", F.when(F.col("blocks") == 1, F.concat_ws("-", F.lit("p"), F.pmod(F.xxhash64("grp"), F.lit(packs))))
                          .otherwise(F.concat_ws("-", "grp", F.least("block", "other"), F.greatest("block", "other"))).alias("work")))
    wanted = stage(found.groupBy("rep").agg(F.collect_set(F.struct("grp", "work")).alias("places")).withColumnRenamed("rep", "doc_id"))
    one = given.filter(F.col("doc_id").isNotNull())

    def sets(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                h, doc = shingle_sets(part.column(1), width)
                n = np.bincount(doc, minlength=len(part))
                ends = np.cumsum(n)
                raw = pa.array([h[e - k:e].tobytes() for e, k in zip(ends, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), raw], names=["doc_id", "places", "payload"])

    place = "array<struct<grp:long,work:string>>"
    held = lookup_join(one, wanted, ["doc_id"]).select("doc_id", "text", "places").mapInArrow(sets, f"doc_id long, places {place}, payload binary")
    held = held.select("doc_id", "payload", F.inline("places"))

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["doc_id", "grp", "payload"])
        sizes = np.array([len(p) // 8 for p in part["payload"]], np.int64)
        shingles = np.frombuffer(b"".join(bytes(p) for p in part["payload"]), np.uint64)
        out = linked(part["doc_id"].to_numpy(), sizes, shingles, part["grp"].to_numpy(), percent)
        release()
        return out

    links = stage(held.groupBy("work").applyInPandas(verify, "src long, dst long"))
    comps = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    named = stage(classes.join(stage(comps), "rep", "left").select("n", "h1", "h2", F.coalesce("component_id", "rep").alias("component_id")))
    linked_rows = lookup_join(sig.filter("n > 0 and doc_id is not null"), named, ["n", "h1", "h2"])
    alone = sig.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (linked_rows.select("doc_id", "n", "component_id").unionByName(alone)
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def _candidates(sig: DataFrame, classes: DataFrame, held: DataFrame, bands: list[tuple[int, int, int]]) -> DataFrame:
    """Edges (src, dst) between sets that share a kept segment and whose sketches are within the bound of their band."""
    lows = F.array(*[F.lit(b[0]) for b in bands])
    slacks = F.array(*[F.lit(_slack(b[1])) for b in bands])
    texts = held.groupBy("set", "back").agg(
        F.max("n_weak").alias("n_weak"), F.array_sort(F.collect_list(F.when(~F.col("weak"), F.struct("rank", "key")))).alias("full"),
        F.array_sort(F.collect_list(F.when(F.col("weak"), F.struct("rank", "key")))).alias("thin"))        # at most as many as the text has segments
    texts = stage(texts).join(classes.withColumnRenamed("h1", "set"), "set")
    band = F.size(F.filter(lows, lambda x: x <= F.col("n"))) - 1 - F.col("back").cast("int")
    texts = texts.withColumn("band", band).withColumn("slack", F.element_at(slacks, F.col("band") + 1))
    take = lambda c, n: F.slice(c, 1, F.greatest(F.lit(0), n))
    kept = F.concat(take("full", F.size("full") + F.col("n_weak") - F.col("slack")), take("thin", F.size("thin") - F.col("slack")))
    kept = stage(texts.select("rep", "set", "band", "back", F.explode(kept).alias("k")).select("rep", "set", "band", "back", F.col("k.key").alias("key")))
    # a segment that only one text has kept, or none in its own band, joins nothing
    several = kept.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("back").alias("away")).filter("n > 1 and not away")
    several = stage(several.select("band", "key", F.ceil(F.col("n") / SKETCHES).cast("int").alias("blocks")))
    places = stage(lookup_join(kept, several, ["band", "key"]).groupBy("rep", "set", "band", "back")
                   .agg(F.collect_list(F.struct("key", "blocks")).alias("keys")))
    # equal rows of an id are one text; another text of the same id has another set
    made = sig.filter("n > 0 and doc_id is not null").select(F.col("doc_id").alias("rep"), F.col("h1").alias("set"), "own", "before").dropDuplicates(["rep", "set"])
    rows = places.join(made, ["rep", "set"]).select("band", F.inline("keys"), "set", F.when(F.col("back"), F.col("before")).otherwise(F.col("own")).alias("sketch"))
    bounds = [b[1] for b in bands]
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    tiled = (rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set", "sketch"))
    work = ["band", "key", "i", "j"]

    def test(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).to_numpy() for c in work]
        group = np.concatenate([[0], np.cumsum(np.any([c[1:] != c[:-1] for c in cols], axis=0))])
        src, dst = [], []
        for band in np.unique(cols[0]):
            at = np.flatnonzero(cols[0] == band)
            raw = np.frombuffer(b"".join(table.column("sketch").take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)
            x, y = within_bound(table.column("set").to_numpy()[at], raw, group[at], bounds[band])
            src.append(x)
            dst.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    def compare(batches):
        held = []                                            # the batches of groups that are not complete yet
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            last = [c.to_numpy() for c in table.select(work).columns]
            open_ = int(np.flatnonzero(np.any([c != c[-1] for c in last], axis=0))[-1]) + 1 if np.any([c[0] != c[-1] for c in last]) else 0
            if open_:
                yield test(table.slice(0, open_))
            held = table.slice(open_).to_batches()
        if held:
            yield test(pa.Table.from_batches(held))

    return tiled.repartition(*work).sortWithinPartitions(*work).mapInArrow(compare, "src long, dst long").filter("src <> dst").distinct()
