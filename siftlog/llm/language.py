"""Language identification by compression with per-language dictionaries.

Each language has a zstandard raw-content dictionary of its texts.  A text is
compressed in blocks with every dictionary, and the language whose dictionary
makes the smallest sum wins.  Texts are lower-cased and reduced to letters first,
so that markup and capitals say nothing.

The dictionaries come from a bounded sample: per language the ``SLOTS`` texts with
the smallest hash in their slot, ``DICT_BYTES`` of dictionary in all.  The sample is an
aggregate with map-side partials, so a language may own any share of the rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import text_batches

SLOTS = 64                    # training texts of a language
DICT_BYTES = 64 << 10         # dictionary bytes of a language
MAX_LANGUAGES = 1000          # more distinct labels are an error, not a cut
LEVEL = 6
BLOCK_BYTES = 2048
MIN_MARGIN = 0.02             # a smaller lead over the second language is not accepted

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-case letters, other runs as one blank."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def train(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language from ``text`` and ``lang``; rows without either are left out."""
    used = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hash_ = F.xxhash64("text")
    slot = F.pmod(hash_, F.lit(SLOTS))
    rows = (used.select("lang", slot.alias("slot"), hash_.alias("h"), "text").groupBy("lang", "slot")
            .agg(F.min_by("text", "h").alias("text")).limit(MAX_LANGUAGES * SLOTS + 1).collect())
    if len(rows) > MAX_LANGUAGES * SLOTS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    texts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["slot"])):
        texts.setdefault(r["lang"], []).append(plain(r["text"]))
    return {lang: b" ".join(t[:DICT_BYTES // len(own)] for t in own) for lang, own in texts.items()}


class Compressors:
    """One compressor per language; lives in a worker process."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = sorted(dictionaries)
        self.made = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        blocks = [raw[i:i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.made]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``accepted``.

    ``margin`` is the share by which the best size is below the second; ``score`` is
    1 - 2^(-margin / min_margin), and ``accepted`` asks for ``min_margin``.  Equal sizes go
    to the first language by name.  A null text or one without a letter gets ``und``, 0,
    0, false, and so does every text if there is no dictionary; with one language alone the margin is 1.
    Columns of these names are replaced.
    """
    text_batches(docs.sparkSession)
    rest = docs.drop("lang_pred", "score", "margin", "accepted")
    at = rest.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def run(batches):
        made = Compressors(dictionaries)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                lang, margin = [], []
                for t in part.column(at).to_pylist():
                    if t is None or not made.langs or not any(map(str.isalpha, t)):
                        lang.append("und")
                        margin.append(0.0)
                        continue
                    sizes = made.sizes(t)
                    order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
                    lang.append(made.langs[order[0]])
                    margin.append((sizes[order[1]] - sizes[order[0]]) / sizes[order[1]] if len(order) > 1 else 1.0)
                m = np.array(margin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(1 - 2.0 ** (-m / min_margin)), pa.array(m), pa.array((m >= min_margin) & (np.array(lang, object) != "und"))],
                                                 names=[*part.schema.names, "lang_pred", "score", "margin", "accepted"])

    return rest.mapInArrow(run, fields + ", lang_pred string, score double, margin double, accepted boolean")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
