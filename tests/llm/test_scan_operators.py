"""Periodic runs, whitening and licence scans against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import licences, periodic, queries, whitening

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 9000
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, None, 6),
    (4, "One two.", None, "a", 8),
    (5, LONG, "fr", None, len(LONG)),
    (5, LONG, "fr", None, len(LONG)),
    (None, "null id here " * 20, "de", "b", 260),
    (6, "É é\x00 é MIT License mit-license; \nApache  LICENSE, gnu general public license " + "x " * 40, "de", "b", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def written(spark, tmp_path, name, df):
    df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


# -- periodic runs


def brute_runs(words):
    """All runs by extending every equal neighbourhood of every period, word by word."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j
    return sorted((s, n_, q) for (s, n_), q in found.items())


def brute_period_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2], sha(listed), sha(kept))


def key(row):
    return tuple((x is None, x) for x in row)


def test_runs_of_random_texts():
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        text = []
        while len(text) < rng.choice([10, 60, 200]):
            piece = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            text += piece * rng.choice([1, 1, 2, 5, 12])
        texts.append(text)
    texts += [[], ["a"] * 24, ["a"] * 23, list("ab") * 500, ["x", *list("abc") * 8, "y"], ["a"] * 3000]
    order = {w: i for i, w in enumerate("abcdefghxy")}
    sizes = np.array([len(t) for t in texts])
    text, *rest = periodic.maximal_runs(np.array([order[w] for t in texts for w in t]), sizes)
    found = [[] for _ in texts]
    for t, *run in zip(text.tolist(), *(x.tolist() for x in rest)):
        found[t].append(tuple(run))
    assert [sorted(f) for f in found] == [brute_runs(t) for t in texts]


def test_hashes_that_lie_are_found_out(monkeypatch):
    """With all words hashed alike at first, the verified runs of a second try are the true ones."""
    true = periodic.Prefixes

    class Lying(true):
        def __init__(self, words, seed):
            super().__init__(words if seed else np.zeros_like(words), seed)

    monkeypatch.setattr(periodic, "Prefixes", Lying)
    words = np.array([0, 1, 2] * 10 + [3, 4] * 20)
    assert [x.tolist() for x in periodic.maximal_runs(words, np.array([len(words)]))] == [[0, 0], [0, 30], [30, 40], [3, 2]]


def test_run_query_equals_brute_force(spark, tmp_path, docs, odd):
    short = [r for r in ODD if r[1] != LONG]
    for name, rows in (("given", docs), ("odd", spark.createDataFrame(short, DOCS))):
        (tmp_path / name).mkdir()
        found = queries.op13_runs(spark, written(spark, tmp_path / name, "documents", rows)).collect()
        expected = [brute_period_row(r["doc_id"], r["text"]) for r in rows.collect()]
        assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert any(r["n_runs"] for r in found)


def test_collapse_odd_rows_and_clashing_columns(spark, odd):
    found = periodic.collapse(odd.select("*", F.lit(1).alias("runs"), F.lit("z").alias("a.b")))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "runs", "collapsed"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(ODD)
    assert rows[1]["text"] is None and rows[1]["collapsed"] == "" and rows[1]["runs"] == [] and rows[3]["collapsed"] == ""
    assert [tuple(r) for r in rows[5]["runs"]] == [(0, 45000, 5)] and rows[5]["collapsed"] == "lorem ipsum dolor sit amet"
    assert rows[None]["collapsed"] == "null id here" and rows[6]["collapsed"].endswith("license x")
    assert periodic.collapse(odd.limit(0)).count() == 0


# -- whitening


VECTORS = "vec_id bigint, embedding array<float>, label int"


def exact_covariance(fit):
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    y = [[n * x[k] - sums[k] for k in range(d)] for x in fit]
    return n, sums, [[sum(r[i] * r[j] for r in y) / n**3 for j in range(d)] for i in range(d)]


def check_whitening(rows, found, components=4):
    usable = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    n, sums, cov = exact_covariance(sorted({tuple(x) for _, x in usable}))
    values, vectors = np.linalg.eigh(np.array(cov, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == len(usable) * min(components, len(sums))
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    signs = {}
    for i, x in usable:
        for r in by_id[i]:
            c = r["component"] - 1
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9) and r["identity_error"] < 1e-9
            expected = (np.array([float(n * a - s) / n for a, s in zip(x, sums)]) @ vectors[:, c]) / math.sqrt(values[c])
            if abs(expected) > 1e-3:
                assert signs.setdefault(c, math.copysign(1, expected * r["whitened"])) == math.copysign(1, expected * r["whitened"])
            assert abs(r["whitened"]) == pytest.approx(abs(expected), rel=1e-6, abs=1e-8)


def test_whitening_of_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = queries.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    check_whitening([(r["vec_id"], r["embedding"]) for r in rows.collect()], found)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=5) * [1, 5, 20, 0.3, 1e4]]) for i in range(60)]
    good += [(100, [0.0] * 5), (101, good[0][1]), (100, good[1][1])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, []), (205, [1.0, 2.0])]
    rows = spark.createDataFrame([(i, v, 0) for i, v in good + bad], VECTORS)
    found = whitening.whiten(rows).collect()
    assert {r["vec_id"] for r in found} == {i for i, _ in good}
    once = [r for r in good if r[0] != 100]
    check_whitening(good, [r for r in found], 4) if len({i for i, _ in good}) == len(good) else None
    n, sums, cov = exact_covariance(sorted({tuple(math.floor(256 * c) for c in v) for _, v in good}))
    assert {r["n"] for r in found} == {n} and len(found) == 4 * len(good)
    for i, v in once:
        assert {r["deviation"] for r in found if r["vec_id"] == i} == {sum((n * math.floor(256 * c) - s) ** 2 for c, s in zip(v, sums))}
    assert whitening.whiten(rows.limit(0)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, 0.0, None)] * 4


def test_sliced_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (10, 1 << 30, 1 << 45):
        y = rng.integers(-most, most, (500, 3))
        wide = y.astype(object)
        for form in (y, wide):
            found = sum(p.astype(object) * (1 << (whitening.LIMB * k)) for k, p in whitening.sliced_products(form).items())
            assert (found == wide.T @ wide).all()
    assert whitening.centred(np.array([[1 << 60]]), 1 << 20, np.array([5], object))[0, 0] == (1 << 80) - 5


# -- licences


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_phrases(text):
    words = LICENCE_WORD.findall(lower(text))
    places = [(label, i) for label, phrase in licences.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for _, i in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in places}))


def test_licence_base_equals_brute_force(spark, tmp_path, docs, odd):
    for name, rows in (("given", docs), ("odd", odd)):
        (tmp_path / name).mkdir()
        found = queries.op12_licences(spark, written(spark, tmp_path / name, "documents", rows)).collect()
        expected = [(r["doc_id"], *brute_phrases(r["text"])) for r in rows.collect()]
        assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=key) == sorted(expected, key=key)
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)


def test_automaton_equals_brute_force():
    """Every stretch that is as long as can be in some template is noted; all templates that hold it are."""
    rng = random.Random(5)
    for _ in range(200):
        templates = [("t", " ".join(rng.choice("abc") for _ in range(rng.randint(4, 15)))) for _ in range(3)]
        machine = licences.Automaton(templates, [("p", "a b"), ("q", "b a c")])
        words = [rng.choice("abcd").encode() for _ in range(60)]
        places, matches = machine.scan(words)
        plain = [w.decode() for w in words]
        texts = [p.split() for _, p in (("p", "a b"), ("q", "b a c"), *templates)]
        inside = lambda stretch, t: any(t[k : k + len(stretch)] == stretch for k in range(len(t)))
        assert sorted(places) == sorted((k, i) for k in (0, 1) for i in range(60) if plain[i : i + len(texts[k])] == texts[k])
        for template, there, at, size in matches:
            assert texts[template][there : there + size] == plain[at : at + size]
        noted = {(t, a, n) for t, _, a, n in matches}
        for end in range(1, 61):
            n = max(k for k in range(end + 1) if k == 0 or any(inside(plain[end - k : end], t) for t in texts))
            grows = end < 60 and any(inside(plain[end - n : end + 1], t) for t in texts)
            if n >= 4 and not grows:
                assert {(t, end - n, n) for t, text in enumerate(texts) if inside(plain[end - n : end], text)} <= noted


def test_whole_and_mended_licences(spark):
    texts = {k: text for k, (_, text) in enumerate(licences.TEMPLATES)}
    rows = [(k, "Foo bar. " * 5 + text + " baz" * 7, None, None, 0) for k, text in texts.items()]
    mit = texts[0].split()
    mended = " ".join("changed" if k % 20 == 10 else w for k, w in enumerate(mit))
    rows += [(100, mended, None, None, 0), (101, " ".join(mit[:30]), None, None, 0), (102, "This is free. You may copy this of any kind.", None, None, 0), (103, texts[0] + " and " + texts[0], None, None, 0)]
    found = {r["doc_id"]: r for r in licences.find(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    for k, (label, text) in enumerate(licences.TEMPLATES):
        assert found[k]["cover"] == 1.0 and label in {s["label"] for s in found[k]["spans"]}
        span = next(s for s in found[k]["spans"] if s["template"] == k + len(licences.PHRASES))
        assert (span["start"], span["end"]) == (10, 10 + len(licences.words_of(text.encode()))) and span["cover"] == 1.0
    assert [s["label"] for s in found[100]["spans"]] == ["mit"] and 0.7 < found[100]["cover"] < 1
    assert not found[101]["spans"] and 0 < found[101]["cover"] < 0.7
    assert not found[102]["spans"]
    assert len([s for s in found[103]["spans"] if s["label"] == "mit"]) == 2
    assert licences.find(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0
