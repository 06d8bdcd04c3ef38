"""Sharding, token files, packing, mixing and neighbour search: round trips and brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import ann, mixing, packing, sharding, tokenfile, tokens
from quillon.llm.queries import BYTE_BPE, QUERIES, WORD_BPE, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet, " * 4000
ODD = [(3, None, "en", "a", None), (1, "", "en", None, 0), (2, LONG, "fr", "a", 1), (2, LONG, "fr", "a", 1), (None, "x <|endoftext|> y", None, None, 3), (9, "日本 “q” ﬁ É", "en", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 97, 1000, 4096, 65537])
def test_permutation_and_inverse(n):
    positions = sharding.permute(np.arange(n), n)
    assert sorted(positions.tolist()) == list(range(n))
    assert np.array_equal(sharding.unpermute(positions, n), np.arange(n))
    if n > 90:
        assert not np.array_equal(positions, np.arange(n)) and not np.array_equal(positions, sharding.permute(np.arange(n), n, seed=1))


def test_sharding(docs, odd, empty):
    table = docs.unionByName(odd)
    found = sharding.assign(table, shards=7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    at = {(r["shard"], r["slot"]): i for i, r in enumerate(order)}
    n = len(found)
    for (shard, slot), i in list(at.items())[:50]:
        back = int(sharding.unpermute(np.array([slot * 7 + shard]), n)[0])
        assert (order[back]["doc_id"], order[back]["text_crc32"]) == (order[i]["doc_id"], order[i]["text_crc32"])
    assert sharding.assign(empty).count() == 0


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_equals_library(name, docs):
    own, library = tokens.Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    random.seed(2)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", "**", "<|endoftext|>", "“x”", "日本", " ", "ß", "İ", "ſ", "don't", "́", "’", "\x1c", "IT'S", "…", "²", "ª"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 12))) for _ in range(3000)] + [r["text"] for r in docs.collect()] + [LONG]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_merges_a_word_once_whatever_marks_follow(name):
    own, library = tokens.Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    merged, asked, merge, ids = [], [], own._merge, own.ids
    own._merge = lambda piece: merged.append(piece) or merge(piece)
    own.ids = lambda texts: asked.extend(texts) or ids(texts)
    texts = ["A quéstion, quéstion... and quéstion*** or quéstion", "B quéstion$$$ quéstion! quéstion (quéstion) quéstion's 'quéstion', œuvre, œuvre.' '", "C quéstion" + "." * 40 + " x"]
    found = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] + [np.frombuffer(own.encode(x), "<u4").tolist() for x in texts]
    assert found == [library.encode(x, add_special_tokens=False).ids for x in texts] * 2
    assert sum("stion" in piece for piece in merged) == 1
    assert not any(x.strip().rstrip(".,*$!") == "quéstion" for x in asked if len(x) < 20)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_token_file_bytes(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 200, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = 50_000
    if n > 1000:
        ids[300:900] = 2**32 - 1  # a block of one value, and the widest offsets beside it
    lengths = [n // 3, 0, n - n // 3]
    found = tokenfile.TokenFile(tokenfile.pack(ids, [5, None, -7], lengths))
    assert np.array_equal(found.ids(), ids) and found.doc_ids == [5, None, -7] and found.lengths.tolist() == lengths
    for a, b in [(0, 1), (n // 2, n), (n // 3, n // 2), (n, n)]:
        assert np.array_equal(found.ids(a, min(b, n)), ids[a : min(b, n)])


def test_token_file_round_trip(docs, odd, empty, monkeypatch):
    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    table = docs.unionByName(odd)
    want, at = [], 0
    for r in sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    rows = tokenfile.round_trip(table, tokenizer_path(BYTE_BPE)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter(want)
    rows.sort(key=lambda r: r["start"])
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == [d for d, _, _ in want]
    assert tokenfile.round_trip(empty, tokenizer_path(BYTE_BPE)).count() == 0


def test_packing(docs, odd, empty):
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    table = docs.unionByName(odd).repartition(5, "doc_id")
    rows = packing.pack(table, tokenizer_path(WORD_BPE), 2, window=512, most=4, fan=2).collect()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 512
    want, total = defaultdict(Counter), 0  # several texts may share an id
    for r in table.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        want[r["doc_id"]].update((s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes()), len(ids)) for s in range(0, len(ids), 512))
    assert {d: Counter((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in held) for d, held in pieces.items()} == want
    assert total / (512 * len(windows)) > 0.95
    with_ids = packing.pack(odd, tokenizer_path(WORD_BPE), 2, ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in with_ids)
    assert packing.pack(empty, tokenizer_path(WORD_BPE), 2).count() == 0


def brute_exponent(shares, limit):
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        ratio = [s ** (mid - 1) for s in shares]
        low, high = (low, mid) if max(ratio) / min(ratio) <= limit else (mid, high)
    return high


def test_mixing(spark, odd, empty):
    random.seed(6)
    rows = [(i, "w " * random.randint(1, 9), "en", "big" if i % 10 else random.choice(["s1", "s2", None]), 1) for i in range(6000)]
    table = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(table, repeat_limit=3.0).collect()
    tokens_of = Counter()
    for r in rows:
        tokens_of[r[3]] += len(r[1].split())
    total = sum(tokens_of.values())
    shares = {s: n / total for s, n in tokens_of.items()}
    power = brute_exponent(list(shares.values()), 3.0)
    z = sum(s**power for s in shares.values())
    got = Counter()
    copies = Counter(r["doc_id"] for r in found)
    assert set(copies) == set(range(6000)) and max(copies.values()) <= 3
    for r in found:
        got[r["source"]] += r["_n_tokens"]
        assert math.isclose(r["_weight"], shares[r["source"]] ** power / z, rel_tol=1e-6)
    for s in shares:
        assert abs(got[s] / sum(got.values()) - shares[s] ** power / z) < 0.01
    half = sorted(found, key=lambda r: r["_position"])[: len(found) // 2]
    part = Counter()
    for r in half:
        part[r["source"]] += r["_n_tokens"]
    assert all(abs(part[s] / sum(part.values()) - shares[s] ** power / z) < 0.04 for s in shares)
    entropy = 1.2
    weights = {r["source"]: r["_weight"] for r in mixing.mix(table, entropy=entropy, repeat_limit=None, budget=5000.0).collect()}
    assert abs(-sum(w * math.log(w) for w in weights.values()) - entropy) < 1e-6
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd.where("doc_id in (1, 3)")).count() == 2


def test_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    query = F.col("vec_id") % 100 == 0
    exact = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.exact(rows, query).collect()}
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(rows, query).collect()}
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    assert len(exact) == 50 and len(found) == 50
    for (q, _), (v, s) in found.items():
        assert math.isclose(s, np.sqrt(((vectors[q] - vectors[v]) ** 2).sum()), rel_tol=1e-12)
    hits = {(q, v) for (q, _), (v, _) in found.items()} & {(q, v) for (q, _), (v, _) in exact.items()}
    assert len(hits) >= 45


def test_neighbours_of_many_scales(spark, tmp_path):
    """Lengths over several powers of ten: the short rows share a list and must still be told apart."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20000, 64)) * np.exp(2 * rng.normal(size=(20000, 1)))
    pq.write_table(pa.table({"vec_id": rng.permutation(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}), tmp_path / "rows.parquet")
    rows = spark.read.parquet(f"file://{tmp_path}/rows.parquet")
    pairs = lambda found: {(r["query_id"], r["vec_id"]) for r in found.collect()}
    true = pairs(ann.exact(rows, F.col("vec_id") % 100 == 0))
    assert len(true) == 2000 and len(true & pairs(ann.search(rows, F.col("vec_id") % 100 == 0))) >= 0.95 * len(true)


def test_neighbours_odd(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 2.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0], 1), (100, [0.0, 1.0], None)]
    found = ann.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 1), (0, 2), (0, 100), (100, 3), (100, 0), (100, 1)]
    assert ann.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0], 0) for i in range(500)], schema)
    got = ann.search(same, F.col("vec_id") == 100).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and all(r["score"] == 0 for r in got)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.ORACLE_SQL is None


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_pipeline_rows_equal_plain_python(spark, tmp_path):
    """Planted short texts, junk, copies, near copies, personal data and sources of unequal size through all five stages."""
    random.seed(12)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8)))
    rows = []
    for i in range(60):
        text = " ".join(word() for _ in range(random.randint(70, 160)))
        rows.append((i, text + (" mail me@x.org now" if i % 7 == 0 else ""), "en", "big" if i < 45 else "small", 0))
    rows += [(100, "too short to stay", "en", "big", 0), (101, None, "en", "big", 0), (102, " ".join(["same words again"] * 40), "en", "big", 0), (103, " ".join(f"{word()}###***$$$" for _ in range(90)), "en", "big", 0)]
    rows += [(200, rows[3][1], "en", "big", 0), (201, rows[4][1].replace(rows[4][1].split()[50], "changed", 1), "en", "small", 0), (200, rows[3][1], "en", "big", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    shingled = {}
    for d, text, *_ in rows:
        if d in (100, 101, 102, 103):
            continue
        words = text.split()
        shingled.setdefault(d, (text, {tuple(words[i : i + 5]) for i in range(len(words) - 4)}))
    stay = []
    for d in sorted(shingled):
        if not any(jaccard(shingled[d][1], shingled[o][1]) >= 0.8 for o in stay):
            stay.append(d)
    assert sorted({r["doc_id"] for r in found}) == stay and {200, 201}.isdisjoint(stay)
    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    copies = Counter(r["doc_id"] for r in found if r["start"] == 0)
    assert all(copies[d] == 1 for d in stay if d < 45) and max(copies.values()) == 2
    for r in found:
        ids = np.array([*library.encode(shingled[r["doc_id"]][0].replace("me@x.org", "[EMAIL]"), add_special_tokens=False).ids, 2], "<u4")
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert (r["length"], r["doc_tokens"], r["ids_crc32"]) == (len(piece), len(ids), zlib.crc32(piece.tobytes()))
    assert Counter(r["doc_id"] for r in found for _ in range(r["length"])) == Counter({d: n * next(r["doc_tokens"] for r in found if r["doc_id"] == d) for d, n in copies.items()})


def test_every_operator_is_registered():
    assert [next(n for n in QUERIES if n.startswith(f"op{i}_")) for i in range(1, 11)]
