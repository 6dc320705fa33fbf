"""Language ID, URL filter, license scan and embeddings."""
import contextlib
import glob
import math
import os
import random
import re
import threading

import numpy as np
import pytest

from siftlog.llm import language
from siftlog.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, scan_licenses
from siftlog.llm.queries import Q
from siftlog.llm.urls import RULES, judge_pages, with_templates
from siftlog.llm.vectors import vector_groups

from .brute import LOWER, components

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in Q["op3_language_id"](spark, SF).collect()]
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > .95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "hello there my friend " * 9, "en", 1), (2, "bonjour mon cher ami " * 9, "fr", 1), (3, None, "fr", 1), (4, "123² ½ !", "en", 1), (5, "bonjour mon cher ami, bonjour mon cher ami", None, 1),
                                (6, "", None, 1), (None, "hello there my friend, hello there my friend", None, 1)], "doc_id long, text string, lang string, score int")
    d = language.train(df)
    assert sorted(d) == ["en", "fr"]
    got = {r["doc_id"]: r for r in language.predict(df, d).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, None)] == ["en", "fr", "und", "und", "fr", "und", "en"]
    assert got[3]["score"] == 0 and not got[3]["accepted"]
    assert {r["lang_pred"] for r in language.predict(df, {}).collect()} == {"und"}
    assert language.predict(df.limit(0), d).count() == 0 and language.train(df.limit(0)) == {}


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return m[1].translate(LOWER), m[2]


def test_url_rules_and_tree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    given = {r["page_id"]: r["url"] for r in pages.collect()}
    rows = judge_pages(pages).collect()
    assert {r["page_id"] for r in rows} == set(given) and len(rows) == len(given)
    for r in rows:
        host, path = plain_url(given[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert rule is None or r["verdict"] == verdict
        assert rule is not None or (r["verdict"] == "block") == (r["purity"] >= .5)
        assert not re.search("[0-9]", r["template"])


def test_url_edges(spark):
    urls = [None, "", "no scheme/es/", "http://A.NET/es/1?x#y", "x://h.net?/es/", "http://net/fr/", "http://com", "http://com/", "http://www.example.com/en/a", "http://b.www.example.com/en/a",
            "http://example.com/en/a", "http://notexample.com/en/", "http://a.org/es/1", "http://u@c.net:80/fr/x#://q", "http://d.net/es\n/1"] + ["http://q.net/es/x%d" % i for i in range(40)] + ["http://q.net/x/y"]
    df = spark.createDataFrame([(i if i != 5 else None, u, "t") for i, u in enumerate(urls)], "page_id int, url string, template string")
    got = {r["page_id"]: r for r in judge_pages(df).collect()}
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        r = got[i if i != 5 else None]
        assert (r["host"], r["path"], r["rule"]) == (host, path, plain_rule(host, path)[0]), u
    assert len(got) == len(urls) and judge_pages(df.limit(0)).count() == 0
    assert {r["verdict"] for r in judge_pages(df, rules=[]).collect()} == {"allow"}
    assert got[len(urls) - 1]["verdict"] == "block"            # nearly all labelled pages of that host are blocked


def test_url_planted_templates_on_large_hosts(spark):
    rows = [("wide.org", f"/{'ads' if i % 2 else 'docs'}/{i}", bool(i % 2)) for i in range(200)] + [("wide.org", f"/{a}{b}/p", None) for a in "abcdefgh" for b in "abcdefgh"]
    rows += [("deep.org", "/a" * 12 + ("/ads" if i % 2 else "/docs"), bool(i % 2)) for i in range(80)]
    rows += [("wide.org", "/ads/new/x", None), ("wide.org", "/docs/new/x", None), ("deep.org", "/a" * 12 + "/ads", None), ("deep.org", "/a" * 12 + "/docs", None)]
    rows += [("none.org", "/en/x", None)]
    got = {(r["host"], r["path"]): r["purity"] for r in with_templates(spark.createDataFrame(rows, "host string, path string, bad boolean")).collect()}
    assert got["wide.org", "/ads/new/x"] > .5 > got["wide.org", "/docs/new/x"] and got["wide.org", "/aa/p"] < .5
    assert got["deep.org", "/a" * 12 + "/ads"] > .5 > got["deep.org", "/a" * 12 + "/docs"]
    assert got["none.org", "/en/x"] == 0


def test_url_pages_of_hosts_without_labels_are_allowed(spark):
    rows = judge_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    labelled = {r["host"] for r in rows if r["rule"] is not None}
    assert {r["verdict"] for r in rows if r["host"] not in labelled} == {"allow"}


def plain_licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    base, at = set(), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        at += hits
        base |= {label} if hits else set()
    labels, score = set(base), 1.0 if at else 0.0
    for line in (text or "").split("\n"):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", line.translate(LOWER))
        for s in range(0, max(1, len(w)), 32):
            block = set(w[s:s + 64])
            for label, t in TEMPLATES:
                share = len(block & set(t.split())) / len(set(t.split()))
                if len(block & set(t.split())) >= math.ceil(THRESHOLD * len(set(t.split())) - 1e-9):
                    labels.add(label)
                    score = max(score, share)
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_licenses_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = " ".join(t for _, t in TEMPLATES).split() + ["x", "the\nof", "MIT-License", "é", "cc,by"]
    texts = [None, "", "...", "CC-BY", "Gnu General\nPublic License; the MIT license. MIT license"]
    for _ in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = "zz"
            k = rng.randrange(len(w) + 1)
            w[k:k] = t
        texts.append(rng.choice([" ", ", ", "\n"]).join(w) if rng.random() < .5 else " ".join(w).title())
    df = spark.createDataFrame([(t, i, "s") for i, t in enumerate(texts)] + [("mit license", None, "s")], "text string, doc_id long, labels string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        assert got[i][:6] == plain_licenses(t)[:6] and got[i][6] == pytest.approx(plain_licenses(t)[6]), t
    assert got[None] == (2, 1, 0, 0, "mit", "mit", 1.0) and scan_licenses(df.limit(0)).count() == 0


def plain_runs(text, templates, width):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    labels, score = set(), 0.0
    for label, t in templates:
        own = set(t.split())
        best = max(len(own & set(words[s:s + width])) for s in range(max(1, len(words))))
        if best >= math.ceil(THRESHOLD * len(own) - 1e-9):
            labels.add(label)
            score = max(score, best / len(own))
    return ",".join(sorted(labels)), score


@pytest.mark.parametrize("extra", [0, 90])
def test_wrapped_notices_match_brute_force(spark, extra):
    rng = random.Random(7 + extra)
    long = " ".join(f"t{i}" for i in range(extra))
    templates = TEMPLATES + ([("long", long)] if extra else [])
    vocabulary = " ".join(t for _, t in TEMPLATES).split()
    texts = [None, "", "of"] + ["# " + "\n#  ".join(" ".join(t.split()[k:k + 8]) for k in range(0, len(t.split()), 8)) for _, t in templates]
    for n in range(200):
        w = [rng.choice(vocabulary) if rng.random() < .2 else f"x{rng.randrange(50)}" for _ in range(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(templates)[1].split()
            for _ in range(rng.randrange(0, 5)):
                k = rng.randrange(len(t))
                t[k:k + 1] = rng.choice([["zz"], [], [t[k], "zz"] * 3])
            k = rng.randrange(len(w) + 1)
            w[k:k] = t
        texts.append("".join(x + ("\n * " if i % 9 == 8 else " ") for i, x in enumerate(w)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(df, templates, {}, across_lines=True).collect()}
    for i, t in enumerate(texts):
        labels, score = plain_runs(t, templates, max(64, 2 * extra))
        assert got[i][0] == labels and got[i][1] == pytest.approx(score), t
    assert all(label in got[3 + i][0] for i, (label, _) in enumerate(templates))
    assert scan_licenses(df.limit(0), across_lines=True).count() == 0


@pytest.mark.parametrize("tile,dims", [(8192, 64), (60, 64), (40, 7)])
def test_vectors_match_brute_force(spark, tile, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(25, dims))
    x = np.concatenate([rng.normal(size=(120, dims)), base, *(base[:12] + rng.normal(size=(12, dims)) * s for s in (.1, .3, .42, .45, .5)), np.repeat(base[:1], 40, 0), base[3:4] * 7,
                        base[:1] + rng.normal(size=(80, dims)) * .12]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    near = unit @ unit.T >= .9
    np.fill_diagonal(near, False)
    comp = components(range(len(x)), zip(*(k.tolist() for k in np.nonzero(near))))
    odd = [(900, None, 1), (901, [0.0] * dims, 1), (902, [float("nan")] + [1.0] * (dims - 1), 1), (903, [None] + [1.0] * (dims - 1), 1), (904, [float("inf")] * dims, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd + [(None, rows[0][1], 1)], "vec_id long, embedding array<float>, n_links int").repartition(4)
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_groups(df, tile=tile).collect()}
    want = {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(x))}
    want |= {i: (0, i, True) for i in range(900, 906)} | {906: (1, 906, True), 907: (1, 906, False), None: (0, None, False)}
    assert got == want
    assert vector_groups(df.limit(0)).count() == 0


def test_vectors_of_one_id_count_for_themselves(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.05]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (9, [-1.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (9, 1, 4, False)]


def test_vectors_are_not_copied_for_each_pair_of_tiles(spark):
    x = np.random.default_rng(5).normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    known, sizes, done = {p for f in folders for p in glob.glob(f"{f}/*/shuffle_*.data")}, {}, threading.Event()

    def watch():                # files go when nothing refers to them any more
        while not done.wait(.02):
            for p in (p for f in folders for p in glob.glob(f"{f}/*/shuffle_*.data") if p not in known):
                with contextlib.suppress(OSError):
                    sizes[p] = os.path.getsize(p)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        assert vector_groups(df, tile=200).filter("n_links = 0 and kept").count() == len(x)
    finally:
        done.set()
        thread.join()
    assert x.nbytes < sum(sizes.values()) < 4 * x.nbytes


@pytest.mark.parametrize("repeats", [2, 10 ** 6])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_that_come_often_match_brute_force(spark, monkeypatch, kind, repeats):
    from siftlog.llm import vectors

    monkeypatch.setattr(vectors, "REPEATS", repeats)        # with and without the shuffle that drops repeats
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 40))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 40)) * .3, np.zeros((1, 40))]).astype(np.float32)
    x[:, 0] = 0
    x[-1, 1] = 1
    ids = rng.integers(0, len(x), 900).tolist()
    rows = [(i, [-0.0 if i % 3 else 0.0, *x[k, 1:].tolist()]) for i, k in enumerate(ids)]       # zeros of both signs are equal
    unit = x[ids].astype(float) / np.sqrt((x[ids].astype(float) ** 2).sum(1, keepdims=True))
    near = unit @ unit.T >= .9
    np.fill_diagonal(near, False)
    comp = components(range(len(rows)), zip(*(k.tolist() for k in np.nonzero(near))))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_groups(df, tile=9).collect()}
    assert got == {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(rows))}


@pytest.mark.parametrize("tiles", [1, 2, 3, 7, 50])
def test_tile_pairs_in_order(tiles):
    from siftlog.llm.vectors import tile_pair

    assert [tile_pair(k, tiles) for k in range(tiles * (tiles + 1) // 2)] == [(x, y) for x in range(tiles) for y in range(x, tiles)]
