import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from siftlog.llm import bpe
from siftlog.llm.token_files import read_token_files, token_folder, write_token_files

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
SHORT = [None, "", " ", "Hello world", "a  b\n\n c\t d", "\n x", "x \n", "don't I'LL", "é é ́a", "<|endoftext|>a <|startoftext|> b", "a\x00b c", " x y  z",
         "İstanbul ΣΑΣ ﬁ", "1234 5,6 !!? ...", "\x1c a\x1cb", "a\r\nb", "日本語 テキスト", "🙂🙂 a🙂"]


def ids_of(path, texts):
    return [np.frombuffer(r, "<u4").tolist() for r in bpe.Encoder(path).ids_bytes(texts)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_short_texts(path):
    texts = [t or "" for t in SHORT]
    assert ids_of(path, texts) == [LIBRARY[path].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' \n\t.!1é́ \x1c\x85<|>endoftext🙂Σİ'sT")), max_size=60))
def test_any_text(path, text):
    assert ids_of(path, [text]) == [LIBRARY[path].encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "the ", "é日🙂x", "!?.", "1a!", "the'sn"])
def test_long_unsplit_text(path, alphabet, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 16)
    rng = random.Random(alphabet)
    enc = bpe.Encoder(path)
    for n in (40, 333, 2000):
        text = "".join(rng.choice(alphabet) for _ in range(n)).replace(" ", "")
        assert enc.long_piece(text) == LIBRARY[path].encode(text, add_special_tokens=False).ids


def documents(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    texts = SHORT + [" ".join(word(rng.randrange(1, 9)) for _ in range(n)) for n in (30, 900, 1500)]
    texts += [word(9000), word(3000) + " " + word(4000) + "!" + word(2500) + "<|endoftext|>" + word(2600), "a b  " * 1500, "x" * 5000 + "\n\n" + "y" * 100]
    rows = [(t, i, "z") for i, t in enumerate(texts)] + [("same", 3, "z"), ("same", 3, "z"), ("null id", None, "z")]
    return rows, spark.createDataFrame(rows, "text string, doc_id long, n_tokens string").repartition(4)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encode_and_decode(spark, path):
    rows, df = documents(spark)
    got = bpe.decoded(bpe.encoded(df, path, long_chars=4000), path).collect()
    want = []
    for t, i, _ in rows:
        ids = LIBRARY[path].encode(t or "", add_special_tokens=False).ids
        want.append((i, t, ids, LIBRARY[path].decode(ids, skip_special_tokens=False)))
    key = lambda r: str(r[:2])
    assert sorted([(r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in got], key=key) == sorted(want, key=key)
    d = {r["doc_id"]: r for r in bpe.digests(bpe.decoded(bpe.encoded(df.filter("doc_id in (0, 19)"), path), path)).collect()}
    assert d[0]["n_tokens"] == 0 and d[0]["ids_sha256"] == d[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = LIBRARY[path].encode(rows[19][0], add_special_tokens=False).ids
    assert d[19]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encoded(df.limit(0), path).count() == 0


def test_token_files_round_trip(spark):
    rows, df = documents(spark)
    got = read_token_files(write_token_files(df, BYTE, token_folder(spark)), with_ids=True).collect()
    want, start = [], 0
    for i, t in sorted([(i, t) for t, i, _ in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = LIBRARY[BYTE].encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert read_token_files(write_token_files(df.limit(0), BYTE, token_folder(spark))).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_marks_and_odd_blanks_as_the_library(name):
    bits = [" ", "  ", "\n", "\t", "don't", "it's", " 's", "Hello", "wörld", "ÀÉ", "日本", "ﬁ", "a1", "99", ".", "!!", "&&&", "'", "<|endoftext|>", "́", "é", "ß",
            "\x00", "　", "\x85", "_", "İ", "ŭ", "ª", "µ", "word,", '"q"', "$$$", "`"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(8000)]
    enc = bpe.Encoder(public_tokenizers.path(name))
    want = [e.ids for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
    got = [raw for i in range(0, len(texts), 500) for raw in enc.ids_bytes(texts[i:i + 500])]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_a_worker_remembers_little_between_tasks(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 20)
    monkeypatch.setattr(bpe, "_encoders", {})
    texts = [" ".join(f"word{i} x{i}," for i in range(k, k + 50)) for k in range(0, 300, 30)] + [""]
    want = [LIBRARY[WORD].encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(r, "<u4").tolist() for r in bpe.encoder(WORD).ids_bytes(texts)] == want
        assert len(bpe.encoder(WORD).cache) > 20
        bpe.forget(WORD)
        assert len(bpe.encoder(WORD).cache) == 20
