"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The n-grams of an item are its word pairs at a distance of one or two, so a pair bears one word
   added, lost or replaced in between.  An alignment that reaches the score keeps at least ``kept``
   of them: it matches so many words that only every second edit can part two neighbours for good.  Items
   for which that says nothing (one or two words) have their words as seeds.
2. One scan counts the n-grams of the items over the whole corpus.  The seeds of an item are its
   rarest, so many that ``need`` of those kept are among them; the most common ones never are.
3. A second scan joins texts and items by seed: passages in which ``need`` seeds of an item lie in as
   many words as an alignment can span at most; overlapping passages join, and no alignment is lost.
   A passage whose words cannot reach the score is left out (its shared words bound the score).
4. The item is aligned with the passage by local alignment of words, which
   bears replaced, added and lost words.

Test items are the stated query set: they are read in blocks of at most
``block_words`` words, and only one block is sent to the tasks at a time, so the size of
what is broadcast is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import lookup_join, number_ordered, stage
from .exchange import release, text_batches
from .words import ALNUM, Words, chunks, mix

MATCH, MISMATCH, GAP = 2, -1, -1
UNIT = 1 << 32                # one point of score in a cell of the alignment
REACH = 2                     # farthest distance of the words of an n-gram
MIN_SCORE = 0.5               # of the score of a whole, equal passage
BLOCK_WORDS = 1_000_000       # words of test items in one broadcast block


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first word and word after the last in ``passage``.

    One row is held, however long the passage is: a cell is its score above 32 bits in which
    the alignment begins.  Of equal scores in a cell the later beginning is kept, of equal best cells the first.
    """
    at = np.arange(len(passage) + 1, dtype=np.int64)           # an empty alignment begins where it stands
    steps = at * -GAP * UNIT
    row, best = at, (0, 0, 0)
    for word in item:
        new = at.copy()
        reached = np.maximum(row[:-1] + np.where(passage == word, MATCH * UNIT, MISMATCH * UNIT), row[1:] + GAP * UNIT)
        np.maximum(new[1:], reached, out=new[1:])
        row = np.maximum.accumulate(new + steps) - steps       # gaps in the item
        score = row >> 32
        end = int(score.argmax())
        if score[end] > best[0]:
            best = int(score[end]), int(row[end] & (UNIT - 1)), end
    return best


class Items:
    """Test items of one block with their words."""

    def __init__(self, ids: list[int], texts: list[str], min_score: float):
        w = Words(pa.array(texts, pa.string()), ALNUM)
        self.ids = ids
        self.words = [w.hash[w.first_word[i]:w.first_word[i + 1]] for i in range(len(ids))]
        self.word, self.number = np.unique(w.hash, return_inverse=True)
        self.first = w.first_word
        size = w.per_doc
        least = np.ceil(min_score * MATCH * size - 1e-9).astype(np.int64)           # the score to reach
        self.span = MATCH * size - least + size                                      # words of the longest passage, each edit costs a point
        self.kept = np.maximum(0, -(-least // MATCH) - 1)                            # n-grams that every such alignment keeps
        self.need = np.maximum(1, self.kept // 2)                                    # seeds that a passage holds
        singles = (self.kept == 0)[w.doc]
        place, gram = pairs(w, ~singles)
        place, gram = np.concatenate([place, np.flatnonzero(singles)]), np.concatenate([gram, w.hash[singles]])
        order = np.argsort(place, kind="stable")
        self.gram, self.gram_number = np.unique(gram[order], return_inverse=True)    # of all items, and of each place
        self.gram_first = np.searchsorted(w.doc[place[order]], np.arange(len(ids) + 1))
        self.has_singles = bool(singles.any())

    def numbers(self, w: Words, words: "Table") -> np.ndarray:
        """The number of each word of a text among the words of the items, one past the last where it is none."""
        out = np.full(len(w.hash), len(self.word))
        place, number = words.find(w.hash)
        out[place] = number
        return out

    def grams(self, w: Words, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the n-grams of texts that could be one of an item."""
        known = numbers < len(self.word)
        place, gram = pairs(w, known)
        if self.has_singles:
            place, gram = np.concatenate([place, np.flatnonzero(known)]), np.concatenate([gram, w.hash[known]])
        return place, gram

    def shared(self, i: int, passage: np.ndarray) -> int:
        """Places of item ``i`` whose word is among the numbers of ``passage``."""
        held = np.zeros(len(self.word) + 1, bool)
        held[passage] = True
        return int(np.count_nonzero(held[self.number[self.first[i]:self.first[i + 1]]]))

    def seeds(self, counts: np.ndarray) -> "Seeds":
        """The rarest n-grams of each item by corpus count, equal counts by hash; those left out are ``kept - need``."""
        item, number = [], []
        for i in range(len(self.ids)):
            own = self.gram_number[self.gram_first[i]:self.gram_first[i + 1]]
            rare = np.unique(own[np.lexsort((own, counts[own]))][:len(own) - max(0, self.kept[i] - self.need[i])])
            item.append(np.full(len(rare), i))
            number.append(rare)
        return Seeds(self, np.concatenate(item), np.concatenate(number))


class Seeds:
    """Sorted seeds, with the items of each."""

    def __init__(self, items: Items, item: np.ndarray, number: np.ndarray):
        order = np.argsort(number, kind="stable")
        used, first = np.unique(number[order], return_index=True)
        self.gram = items.gram[used]
        self.low, self.high = first, np.append(first[1:], len(order))
        self.item = item[order]


def pairs(w: Words, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first word and values of all pairs of ``used`` words at a distance up to ``REACH`` in one text."""
    place, gram = [np.zeros(0, int)], [np.zeros(0, np.uint64)]
    for d in range(1, REACH + 1):
        at = np.flatnonzero(used[:-d] & used[d:] & (w.doc[:-d] == w.doc[d:]))
        place.append(at)
        gram.append(mix(w.hash[at] * np.uint64(0xD6E8FEB86659FD93) + w.hash[at + d]))
    return np.concatenate(place), np.concatenate(gram)


class Table:
    """Sorted values with a bit table before the search, about 16 bits a value; built once in each task."""

    def __init__(self, values: np.ndarray):
        self.values = values
        size = 1 << max(16, (16 * len(values)).bit_length())
        self.mask = np.uint64(size - 1)
        self.bits = np.zeros(size, bool)
        self.bits[values & self.mask] = True

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``wanted`` that occur in the table, and where."""
        if not len(self.values) or not len(wanted):
            return np.zeros(0, int), np.zeros(0, int)
        near = np.flatnonzero(self.bits[wanted & self.mask])
        at = np.searchsorted(self.values, wanted[near])
        at[at == len(self.values)] = 0
        hit = self.values[at] == wanted[near]
        return near[hit], at[hit]


def candidates(w: Words, items: Items, seeds: Seeds, table: Table, numbers: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, word after the last) of every passage to align, in words of the batch."""
    place, gram = items.grams(w, numbers)
    near, entry = table.find(gram)
    place = place[near]
    if not len(place):
        return []
    order = np.argsort(place, kind="stable")
    place, entry = place[order], entry[order]
    lens = seeds.high[entry] - seeds.low[entry]
    flat = np.repeat(seeds.low[entry] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
    place = np.repeat(place, lens)
    item = seeds.item[flat]
    key = w.doc[place] * len(items.ids) + item
    order = np.argsort(key, kind="stable")                   # places stay in order
    place, item, key = place[order], item[order], key[order]
    last = np.arange(len(place)) + items.need[item] - 1
    near = np.flatnonzero(last < len(place))
    last = last[near]
    near_enough = (key[last] == key[near]) & (place[last] - place[near] < items.span[item[near]])
    near, last = near[near_enough], last[near_enough]
    if not len(near):
        return []
    i, d = item[near], w.doc[place[near]]
    low = np.maximum(place[last] - items.span[i] + 1, w.first_word[d])
    high = np.minimum(place[near] + items.span[i], w.first_word[d + 1])
    # both ends grow within a key; overlapping passages join
    new = np.flatnonzero(np.concatenate([[True], (key[near][1:] != key[near][:-1]) | (low[1:] > high[:-1])]))
    end = np.append(new[1:], len(near)) - 1
    return list(zip(d[new].tolist(), i[new].tolist(), low[new].tolist(), high[end].tolist()))


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word``: items that a text holds, whole or edited.

    ``score`` is the alignment score over that of an equal passage (0 to 1);
    pairs from ``min_score`` on are returned, with the best place in words (ALNUM
    words from 0, last included).  Null or wordless texts and items match nothing,
    rows with equal ids are judged one by one, a null doc_id is returned as null, a null item_id is left out.
    """
    text_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, item_id long, score double, first_word long, last_word long"
    items = stage(benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")))
    words = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    if words > block_words:            # running sums over ordered ranges; no single task sees all items
        numbered = stage(number_ordered(items, [F.col("item_id"), F.col("text")], "place"))
        longest = numbered.agg(F.max(F.octet_length("text") / 2 + 1)).first()[0]
        per_block = max(1, int(block_words // longest))
        blocks = [numbered.filter(F.col("place").between(s, s + per_block - 1)) for s in range(0, numbered.count(), per_block)]
    else:
        blocks = [items]
    found = [_block_leaks(given, sorted(b.select("item_id", "text").collect()), min_score, kinds) for b in blocks]      # at most block_words words each
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block_leaks(given: DataFrame, rows: list, min_score: float, kinds: str) -> DataFrame:
    spark = given.sparkSession
    items = Items([r["item_id"] for r in rows], [r["text"] for r in rows], min_score)
    if not len(items.word):
        return spark.createDataFrame([], kinds)

    def count(batches):
        seen = np.zeros(len(items.gram), np.int64)
        words, table = Table(items.word), Table(items.gram)
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                w = Words(batch.column(0).slice(a, b - a), ALNUM)
                np.add.at(seen, table.find(items.grams(w, items.numbers(w, words))[1])[1], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["gram", "n"])

    counted = given.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(items.gram), np.int64)
    for r in counted:                                        # no more rows than n-grams of the block
        counts[r["gram"]] = r["n"]
    seeds = items.seeds(counts)

    def match(batches):
        words, table = Table(items.word), Table(seeds.gram)
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                part = batch.slice(a, b - a)
                w = Words(part.column(1), ALNUM)
                best: dict[tuple[int, int], tuple] = {}
                numbers = items.numbers(w, words)
                for d, i, low, high in candidates(w, items, seeds, table, numbers):
                    item, passage = items.words[i], w.hash[low:high]
                    if MATCH * items.shared(i, numbers[low:high]) < min_score * MATCH * len(item):      # no alignment reaches the score
                        continue
                    score, s, e = align(item, passage)
                    if score >= min_score * MATCH * len(item):
                        start = int(low - w.first_word[d])
                        best[d, i] = max(best.get((d, i), (-1,)), (score, -(start + s), start + e - 1))
                if best:
                    keys = list(best)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array([d for d, _ in keys])), pa.array([items.ids[i] for _, i in keys], pa.int64()),
                        pa.array([best[k][0] / (MATCH * len(items.words[k[1]])) for k in keys], pa.float64()),
                        pa.array([-best[k][1] for k in keys], pa.int64()), pa.array([best[k][2] for k in keys], pa.int64())],
                        names=["doc_id", "item_id", "score", "first_word", "last_word"])
        del words, table
        release()

    return given.mapInArrow(match, kinds)


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the texts that hold a test item; rows with a null id stay."""
    hit = stage(leaks(docs, benchmark, min_score).filter(F.col("doc_id").isNotNull()).select("doc_id").distinct())
    return lookup_join(docs, hit, ["doc_id"], "left_anti").select(*docs.columns)
