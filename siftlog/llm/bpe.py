"""BPE encoding and decoding with a tokenizer file; long unsplit text by tree concatenation.

The vocabulary's own splitter never joins text across certain blanks, so a text
is a sequence of pieces that encode independently; each task keeps the ids of
pieces it has met.  A long piece is cut in halves again and again, the
leaves are encoded, and each join re-encodes a window around it that grows until
its first tokens are the left side's and its last tokens the right side's.  Every
adjacent pair of tokens then stands in some encoding the merges have made, so
the joined ids are those of the whole.

Texts over ``LONG_CHARS`` are spread over the cluster: their parts are rows that
are encoded anywhere and joined per text.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .exchange import release, text_batches
from .words import chunks

LEAF = 512                    # characters that are encoded in one go
AGREE = 2                     # tokens on which a window and each side must agree
LONG_CHARS = 60_000           # a longer text is encoded in parts over the cluster
CACHE = 800_000               # pieces that a worker remembers; does not change results
KEPT = 100_000                # of them, those that it remembers from one task to the next: frequent pieces come early
MARKS = ",.!?;:"
# the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_SIGNS = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
NARROW = np.dtype("<u4")

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget(path: str) -> None:
    """At the end of a task: workers live on between stages."""
    known = _encoders.get(path)
    if known and len(known.cache) > KEPT:
        known.cache = dict(islice(known.cache.items(), KEPT))
    release()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.tok, self.model, self.suffix = tok, tok.model, getattr(tok.model, "end_of_word_suffix", None) or ""
        special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        probe = tok.encode(" a  a\n", add_special_tokens=False).tokens
        self.drops_blanks = all("Ġ" not in t and "Ċ" not in t for t in probe)
        self.names = np.array([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))], object)
        self.cache: dict[str, bytes] = {"": b""}
        plain = tok.to_str()
        self.known = self.drops_blanks and '"Removed"' in plain or '"ByteLevel"' in plain and '"use_regex":true' in plain.replace(" ", "")
        self.bytewise = self.known and not self.drops_blanks and tok.normalizer is None
        # no special token may lie in a word and its marks: each starts with a mark and holds a letter or digit
        apart = self.known and all(not t[0].isalnum() and any(map(str.isalnum, t)) for t in special if t)
        self.marks = "" if not apart else string.punctuation if self.bytewise else MARKS
        self.bytewise = self.bytewise and apart

    # pieces

    def pieces(self, text: str) -> list[str]:
        """Pieces whose ids, one after the other, are the ids of the text."""
        if not self.known:
            return [text]
        if self.drops_blanks:
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if any(b in text for b in _UNEVEN):
            return _BEFORE_BLANK.split(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def ids_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit little-endian bytes."""
        split = [self.pieces(t) for t in texts]
        cache = self.cache
        new = set().union(*split).difference(cache) if split else set()      # of the dict: its key view would be walked whole
        full, own = len(cache) >= CACHE, set(new)
        if new:
            # a word of letters and the marks after it never share a token: they encode apart
            ends = {p: q for p in new if (q := p.rstrip(self.marks)) != p and self.is_word(q)} if self.marks else {}
            new.difference_update(ends)
            new.update(ends.values(), (p[len(q):] for p, q in ends.items()))
            new = new.difference(cache)
            own |= new
            words = [p for p in new if self.bytewise and len(p) <= LEAF and self.is_word(p)]
            cache.update(zip(words, map(self.word, words)))
            new.difference_update(words)
            short = [p for p in new if len(p) <= LEAF]
            for p, e in zip(short, self.tok.encode_batch_fast(short, add_special_tokens=False)):
                cache[p] = array("I", e.ids).tobytes()
            for p in new:
                if len(p) > LEAF:
                    cache[p] = array("I", self.long_piece(p)).tobytes()
            for p, q in ends.items():
                cache[p] = cache[q] + cache[p[len(q):]]
        get = cache.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        if full:                                              # frequent pieces came early and stay; what came now goes
            for p in own:
                cache.pop(p, None)
        return out

    @staticmethod
    def is_word(p: str) -> bool:
        """Latin letters, with or without a blank before them (letters of other alphabets may turn into a letter and a sign)."""
        body = p[1:] if p[:1] == " " else p
        return body.isalpha() and (body.isascii() or max(body) < "\u0130")

    def word(self, p: str) -> bytes:
        """Ids of a word that the byte-level splitter leaves whole: straight from the merges."""
        signs = ("\u0120" + p[1:] if p[0] == " " else p) if p.isascii() else p.encode().decode("latin-1").translate(BYTE_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    # long pieces

    def strings(self, piece: str) -> list[tuple[str, int | None]]:
        """The strings that the merges work on, as (string, None), and special tokens as (text, id)."""
        out = []
        for part in self.special_pattern.split(piece) if self.special_pattern else [piece]:
            if part in self.special:
                out.append((part, self.special[part]))
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out += [(s, None) for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    def long_piece(self, piece: str) -> list[int]:
        out: list[int] = []
        for s, special in self.strings(piece):
            out += [special] if special is not None else self.tree(s)
        return out

    def leaf(self, s: str) -> list[int]:
        return [t.id for t in self.model.tokenize(s)]

    def tree(self, s: str) -> list[int]:
        if len(s) <= LEAF:
            return self.leaf(s)
        mid = len(s) // 2
        return self.join(self.tree(s[:mid]), self.tree(s[mid:]))

    def text_of(self, ids: list[int]) -> list[str]:
        """The characters of each token, without the mark of a word's end."""
        n = len(self.suffix)
        return [t[:-n] if n and t.endswith(self.suffix) else t for t in self.names[ids]]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two neighbouring runs of one unsplit string; the end of ``right`` counts as the string's end."""
        if not left or not right:
            return left + right
        width = 8
        while True:
            a, b = left[-width:], right[:width]
            ta, tb = self.text_of(a), self.text_of(b)
            window = self.leaf("".join(ta) + "".join(tb))
            from_left = len(a) == len(left) or window[:AGREE] == a[:AGREE]
            if from_left and len(b) == len(right):
                return left[:-width] + window if len(a) < len(left) else window
            if from_left:
                # tokens of the window and of the right side that stand at the same place; the last one of the window ends too early
                ends = np.cumsum([len(t) for t in self.text_of(window)]).tolist()
                at = {e: k for k, e in enumerate(ends[:-1])}
                own = (np.cumsum([len(t) for t in tb]) + sum(map(len, ta))).tolist()
                for j in range(AGREE - 1, len(b)):
                    k = at.get(own[j], -1)
                    if k >= AGREE - 1 and window[k - AGREE + 1:k + 1] == b[j - AGREE + 1:j + 1]:
                        return (left[:-width] if len(a) < len(left) else []) + window[:k + 1] + right[j + 1:]
            width *= 2

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """As the tokenizer decodes with special tokens kept."""
        if self.tok.decoder is None:
            return " ".join(self.names[ids])
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


# two blanks together, or a blank that is neither a space nor a line end
_UNEVEN = ["\x00", "  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= \S)")


def _list_of_ids(raw: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), NARROW).astype(np.int32)))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encoded(docs: DataFrame, path: str, long_chars: int = LONG_CHARS) -> DataFrame:
    """``docs`` with ``ids array<int>`` of the whole ``text``, without added special tokens.

    A null or empty text has no ids.  All rows stay, equal ones too; a column
    ``ids`` is replaced.  The file at ``path`` must be readable where the tasks run.
    """
    text_batches(docs.sparkSession)
    docs = docs.drop("ids")
    at = docs.columns.index("text")
    fields = _fields(docs)

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                raw = encoder(path).ids_bytes([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, _list_of_ids(raw)], names=[*part.schema.names, "ids"])
            release()
        forget(path)

    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = docs.filter(size <= long_chars).mapInArrow(run, fields + ", ids array<int>")
    return short.unionByName(_encoded_in_parts(docs.filter(size > long_chars), path, long_chars))


def _encoded_in_parts(docs: DataFrame, path: str, long_chars: int) -> DataFrame:
    """Long texts: parts of whole pieces (kind 0), halves of long strings (1, the last one 2), special tokens (3)."""
    names, at, fields = docs.columns, docs.columns.index("text"), _fields(docs)
    part_chars = max(LEAF, long_chars // 4)

    def parts(text: str):
        enc, held, size = encoder(path), [], 0
        for p in enc.pieces(text):
            if len(p) > part_chars and enc.known:
                if held:
                    yield 0, _glue(enc, held)
                    held, size = [], 0
                for s, special in enc.strings(p):
                    if special is not None:
                        yield 3, str(special)
                        continue
                    cuts = list(range(0, len(s), part_chars))
                    for k, c in enumerate(cuts):
                        yield 2 if k == len(cuts) - 1 else 1, s[c:c + part_chars]
                continue
            held.append(p)
            size += len(p) + 1
            if size >= part_chars:
                yield 0, _glue(enc, held)
                held, size = [], 0
        if held:
            yield 0, _glue(enc, held)

    def split(batches):
        row = (TaskContext.get().partitionId() << 33) - 1        # the same for a repeated task
        for batch in batches:
            for i in range(len(batch)):
                row += 1
                found = list(parts(batch.column(at)[i].as_py()))
                own = pa.array([i], pa.int64())
                for k, (kind, s) in enumerate(found):
                    first = [c.take(own) if k == 0 else pa.nulls(1, c.type) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*first, pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([kind], pa.int32()), pa.array([s], pa.string())],
                                                     names=[*names, "_row", "_part", "_kind", "_s"])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            kind, s = batch.column(len(names) + 2).to_pylist(), batch.column(len(names) + 3).to_pylist()
            raw = []
            for k, t in zip(kind, s):
                ids = enc.ids_bytes([t])[0] if k == 0 else np.array([int(t)] if k == 3 else enc.tree(t), NARROW).tobytes()
                raw.append(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], names=[*names, "_row", "_part", "_kind", "_ids"])

    def whole(group: pa.Table) -> pa.Table:
        enc = encoder(path)
        group = group.sort_by("_part")
        out, open_ = [], []                                     # open_: ids of the halves of one string so far
        for kind, raw in zip(group["_kind"].to_pylist(), group["_ids"].to_pylist()):
            if kind in (0, 3):
                out.append(raw)
                continue
            open_.append(np.frombuffer(raw, NARROW).tolist())
            if kind == 2:
                while len(open_) > 1:                           # join neighbours, as in a tree
                    open_ = [enc.join(*open_[i:i + 2]) if i + 1 < len(open_) else open_[i] for i in range(0, len(open_), 2)]
                out.append(np.array(open_[0], NARROW).tobytes())
                open_ = []
        first = group.slice(0, 1)
        return pa.Table.from_arrays([*[first[n] for n in names], _list_of_ids([b"".join(out)])], names=[*names, "ids"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(split, fields + ", _row long, _part int, _kind int, _s string").repartition(n, "_row", "_part")
    coded = rows.mapInArrow(run, fields + ", _row long, _part int, _kind int, _ids binary")
    return coded.groupBy("_row").applyInArrow(whole, fields + ", ids array<int>")


def _glue(enc: Encoder, held: list[str]) -> str:
    return " ".join(held) if enc.drops_blanks else "".join(held)


def decoded(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``decoded``: the text of ``ids``, special tokens kept; null ids give a null text."""
    text_batches(df.sparkSession)
    df = df.drop("decoded")
    at = df.columns.index("ids")

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                ids = part.column(at)
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                out = [enc.decode(flat[s:e]) if ok else None for s, e, ok in zip(ends[:-1], ends[1:], ids.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])
            release()

    return df.mapInArrow(run, _fields(df) + ", decoded string")


def digests(df: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded texts."""
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                     F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                     F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
