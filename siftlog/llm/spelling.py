"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and the acceptor again.

The words of a corpus and their counts form the vocabulary.  Two words are near
if one code point is inserted, deleted or replaced.  Near words of lengths L and
L or L + 1 share their first ``L // 2`` code points, or else their last ``L - L // 2``:
whichever part the edit spares.  So each word enters four partitions: for both lengths, the
state that a vocabulary acceptor is in after that prefix, and the state of the acceptor of the
reversed words after that suffix.

In each partition the acceptors of what is left of the words (those of length L, and those of
L + 1) are minimised, composed with the transducer, trimmed to states on an
accepted path, and their accepted pairs enumerated.  A pair with both parts in common counts in
the partition of the prefix only.  Pairs leave a partition summed by word.

Skew: a partition with more than ``group_words`` words is cut into tiles, and
every ordered pair of tiles is composed by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import lookup_join, stage
from .exchange import text_batches
from .words import LOWER, chunks, mix, text_bytes

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
SLIP = 199                    # one run of so many loses a code point (see ``occurrences``)
GROUP_WORDS = 20_000          # words of a partition before it is cut into tiles
COUNT_BYTES = 1 << 20         # texts are counted in runs of about this many bytes
LONG_RUN = 64                 # bytes of runs that are worked on all at once, longer ones come one by one
LEAD = 0xC3                   # first byte of U+00C0 to U+00FF in UTF-8
NOT_YET = None                # state of the transducer before its edit
VARIANTS = "word string, n_near long, best_n long, best string"


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


CRC = _crc_table()


def letter_runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last and text of every maximal run of A-Z, a-z, U+00C0 to U+00FF."""
    n = len(raw)
    low = LOWER[raw]
    inside = (low >= 97) & (low <= 122)
    lead = np.flatnonzero(raw == LEAD)
    inside[lead] = True
    inside[lead + 1] = True                                # U+00C0 to U+00FF are all the code points of this lead byte
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(at, begin, side="right") - 1


def slipped(run: str, h: int) -> str:
    i = h % len(run)
    return run[:i] + run[i + 1:]


def occurrences(ids: Iterable, texts: pa.Array, min_length: int = MIN_LENGTH, slip: int = SLIP) -> tuple[pa.Array, np.ndarray]:
    """Words of some texts and how often each occurs; a word may come more than once.

    With h the crc32 of ``<id>:<run>``, a run loses its code point h % length where ``slip`` divides h.
    """
    raw, at = text_bytes(texts)
    begin, end, doc = letter_runs(raw, at)
    low = LOWER[raw]
    wide = np.flatnonzero(raw == LEAD)
    points = end - begin - (np.searchsorted(wide, end) - np.searchsorted(wide, begin))
    use = points >= min_length
    begin, end, doc, size = begin[use], end[use], doc[use], (end - begin)[use]
    heads = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], np.uint32)
    body = np.full(len(begin), 0xFFFFFFFF, np.uint32)       # state of the crc of the run alone
    start = heads[doc] ^ np.uint32(0xFFFFFFFF) if len(doc) else body
    key = np.zeros(len(begin), np.uint64)
    for k in range(min(int(size.max(initial=0)), LONG_RUN)):
        on = np.flatnonzero((size > k) & (size <= LONG_RUN))
        byte = low[begin[on] + k]
        start[on] = CRC[(start[on] ^ byte) & 255] ^ (start[on] >> np.uint32(8))
        key[on] = mix(key[on] ^ (byte.astype(np.uint64) + np.uint64(257)))
    h = (start ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    words, counts = [], []
    for r in np.flatnonzero((size > LONG_RUN) | (h % slip == 0)):
        run = low[begin[r]:end[r]].tobytes()
        own = zlib.crc32(run, int(heads[doc[r]]))
        word = run.decode()
        word = slipped(word, own) if own % slip == 0 else word
        if len(word) >= min_length:
            words.append(word)
            counts.append(1)
    plain = np.flatnonzero((size <= LONG_RUN) & (h % slip != 0))
    _, first, n = np.unique(key[plain], return_index=True, return_counts=True)
    first = plain[first]
    spell = np.concatenate([[0], np.cumsum(size[first])])
    letters = low[np.repeat(begin[first] - spell[:-1], size[first]) + np.arange(spell[-1])]
    distinct = pa.StringArray.from_buffers(len(first), pa.py_buffer(spell.astype(np.int32)), pa.py_buffer(letters))
    return pa.concat_arrays([distinct, pa.array(words, pa.string())]), np.concatenate([n, np.array(counts, np.int64)])


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of at least ``min_length`` code points that occur ``min_count`` times or more.

    A null text has no words; a null id is written as nothing before the colon; rows with equal ids are read one by one.
    """
    text_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1), COUNT_BYTES):
                words, n = occurrences(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a), min_length, slip)
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Acceptor:
    """A minimal acyclic automaton: ``arcs`` of each state by symbol, ``final`` states, ``start``.  Words come sorted."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self.start = 0
        known: dict[tuple, int] = {}
        open_, before = [0], ""                             # states along the last word, not yet merged
        for word in words:
            same = 0
            while same < len(word) and same < len(before) and word[same] == before[same]:
                same += 1
            self._merge(open_, before, same, known)
            for c in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[open_[-1]][c] = len(self.arcs) - 1
                open_.append(len(self.arcs) - 1)
            self.final[open_[-1]] = True
            before = word
        self._merge(open_, before, 0, known)

    def _merge(self, open_: list[int], word: str, depth: int, known: dict[tuple, int]) -> None:
        """States of ``word`` below ``depth`` become the equal state that is known, or are known from now on."""
        while len(open_) > depth + 1:
            state = open_.pop()
            own = known.setdefault((self.final[state], *self.arcs[state].items()), state)
            if own != state:
                self.arcs[open_[-1]][word[len(open_) - 1]] = own


def composed(left: Acceptor, right: Acceptor, insert: bool) -> Iterator[tuple[str, str]]:
    """Pairs (x of ``left``, y of ``right``) with one code point replaced, or inserted in y.

    A replacement is taken in the order of the symbols, and a symbol is inserted behind equal ones
    (the next one differs), so that each pair comes once.  The third part of a state is the transducer's: ``NOT_YET``, or
    after the edit the symbol that must not come next, if any.
    """
    la, ra, lf, rf = left.arcs, right.arcs, left.final, right.final
    first = (left.start, right.start, NOT_YET)
    arcs: dict[tuple, list] = {}
    todo = [first]
    while todo:                                              # states of the composition that can be reached
        state = todo.pop()
        if state in arcs:
            continue
        p, q, edit = state
        a, b = la[p], ra[q]
        then = NOT_YET if edit is NOT_YET else ""
        out = [(c, c, (a[c], b[c], then)) for c in a.keys() & b.keys() if c != edit]
        if edit is NOT_YET and insert:
            out += [("", c, (p, r, c)) for c, r in b.items()]
        elif edit is NOT_YET:
            out += [(c, d, (s, r, "")) for c, s in a.items() for d, r in b.items() if c < d]
        # an edited state lives only if it ends here or both go on alike
        arcs[state] = out = [x for x in out if x[2][2] is NOT_YET or (lf[x[2][0]] and rf[x[2][1]]) or la[x[2][0]].keys() & ra[x[2][1]].keys()]
        todo += [x[2] for x in out if x[2] not in arcs]
    back: dict[tuple, list] = {}
    for state, out in arcs.items():
        for _, _, to in out:
            back.setdefault(to, []).append(state)
    live = {s for s in arcs if s[2] is not NOT_YET and lf[s[0]] and rf[s[1]]}
    todo = list(live)
    while todo:                                              # trimmed to those on an accepted path
        for state in back.get(todo.pop(), ()):
            if state not in live:
                live.add(state)
                todo.append(state)
    if first not in live:
        return
    paths = [(first, None)]
    while paths:
        state, trail = paths.pop()
        if state[2] is not NOT_YET and lf[state[0]] and rf[state[1]]:
            x, y, t = [], [], trail
            while t is not None:
                t, c, d = t
                x.append(c)
                y.append(d)
            yield "".join(reversed(x)), "".join(reversed(y))
        for c, d, to in arcs[state]:
            if to in live:
                paths.append((to, (trail, c, d)))


def near_pairs(left: list[str], short: list[str], long_: list[str]) -> Iterator[tuple[str, str]]:
    """Near pairs of a partition: ``left`` and ``short`` hold rests of one length, ``long_`` those with one code point more, all sorted."""
    if not left:
        return
    own = Acceptor(left)
    if short is not left or len(left) > 1:
        yield from composed(own, own if short is left else Acceptor(short), False)
    if long_:
        yield from composed(own, Acceptor(long_), True)


def _partitions(word: Column, min_length: int) -> Column:
    """The four partitions of a word: (length, reversed, the part in common, the rest, whether it is the longer one)."""
    size, out = F.char_length(word), []
    for more in (0, 1):
        base = size - more
        half = F.floor(base / 2).cast("int")
        common, rest = F.substring(word, F.lit(1), half), F.substring(word, half + 1, size)
        ends = base - half
        out += [F.struct(base.alias("band"), F.lit(False).alias("back"), common.alias("common"), rest.alias("rest"), F.lit(bool(more)).alias("longer")),
                F.struct(base.alias("band"), F.lit(True).alias("back"), F.substring(word, size - ends + 1, ends).alias("common"),
                         F.reverse(F.substring(word, F.lit(1), size - ends)).alias("rest"), F.lit(bool(more)).alias("longer"))]
    return F.filter(F.array(*out), lambda p: p["band"] >= min_length)


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near words: how many, and the one of largest ``n``, of equal ones the smallest.

    ``words`` is (word, n), each word once; words shorter than ``min_length`` (2 at least) are near to nothing.
    """
    placed = words.select("word", "n", F.inline(_partitions(F.col("word"), max(2, min_length))))
    keys = ["band", "back", "common"]
    crowded = stage(placed.groupBy(*keys).count().filter(F.col("count") > group_words).select(*keys, F.ceil(F.col("count") / group_words).cast("int").alias("tiles")))
    tiled = lookup_join(placed, crowded, keys, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own, every = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"), F.sequence(F.lit(0), F.col("tiles") - 1)
    struct = lambda i, j, left, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(left).alias("l"), F.lit(right).alias("r"))
    # as the left word in row ``own`` of the tiles, as the right one in column ``own``; the longer word is never the left one
    several = F.concat(F.filter(F.transform(every, lambda k: struct(own, k, True, False)), lambda s: ~F.col("longer")), F.transform(every, lambda k: struct(k, own, False, True)))
    places = F.when(F.col("tiles") == 1, F.array(struct(F.lit(0), F.lit(0), True, True))).otherwise(several)
    work = [*keys, "i", "j"]
    sent = tiled.select(*keys, "rest", "n", "longer", F.inline(places)).repartition(*work).sortWithinPartitions(*work, "rest")

    def variants(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        band, back, common = key[:3]
        counts = {r: n for r, n, *_ in rows}
        right = [r for r, _, longer, _, on in rows if on and not longer]
        left = [r for r, _, longer, on, _ in rows if on and not longer]
        found: dict[str, list] = {}
        for x, y in near_pairs(left, right if right != left else left, [r for r, _, longer, _, on in rows if on and longer]):
            if back and y.endswith(x) and len(y) > len(x):
                continue                                      # both parts in common: counted by the prefix
            for a, b in ((x, y), (y, x)):
                best = found.setdefault(a, [0, 0, ""])
                best[0] += 1
                word = b[::-1] + common if back else common + b
                if (-counts[b], word) < (-best[1], best[2]) or not best[1]:
                    best[1:] = counts[b], word
        for a, (near, n, word) in found.items():
            yield a[::-1] + common if back else common + a, near, n, word

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            names = {f: i for i, f in enumerate(batch.schema.names)}
            at = [cols[names[k]] for k in work]
            for k, *row in zip(zip(*at), *(cols[names[c]] for c in ("rest", "n", "longer", "l", "r"))):
                if k != key:
                    if len(rows) > 1:
                        out += variants(key, rows)
                    key, rows = k, []
                rows.append(tuple(row))
            if len(out) > 50_000:
                yield _variant_batch(out)
                out = []
        if len(rows) > 1:
            out += variants(key, rows)
        if out:
            yield _variant_batch(out)

    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return (sent.mapInArrow(run, VARIANTS).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best")))


def _variant_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(map(itemgetter(i), rows), k) for i, k in enumerate(kinds)], names=["word", "n_near", "best_n", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``, each word once and no circles: forms are followed to the last by doubling."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = stage(lookup_join(now, ahead, ["root"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = joined.drop("_moved")
        if joined.filter("_moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, slip: int = SLIP,
                    id_col: str = "doc_id", text_col: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of the vocabulary with the word that it is a variant of.

    ``form`` is the near word of largest count (of equal ones the smallest by code points), if that is at least
    ``ratio`` times the own one, else null; ``root`` follows forms to the last (the word itself without a form).
    An empty table, and texts that are null or without letters, give no words; other columns are ignored.
    """
    words = stage(vocabulary(docs, min_length, min_count, slip, id_col, text_col))
    near = stage(near_words(words, min_length, group_words))
    keep = F.col("best_n") >= ratio * F.col("n")
    table = stage(lookup_join(words, near, ["word"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(keep, F.col("best")).alias("form"), F.when(keep, F.col("best_n")).alias("form_n")))
    last = roots(table.filter(F.col("form").isNotNull()).select("word", "form"))
    return lookup_join(table, last, ["word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
