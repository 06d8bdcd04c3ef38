"""Quality rules, personal data, SimHash, languages and the class model against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import classlm, components, langid, mixing, nearcopies, packing, pii, quality, simhash
from quillon.llm.queries import WORD_BPE, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 9000

ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", None, None, 6),
    (4, "One two three four.", None, "a", 19),
    (5, LONG, "fr", None, len(LONG)),
    (5, LONG, "fr", None, len(LONG)),
    (None, "null id here", "de", "b", 12),
    (6, "É # é\n$ x\n$ x\nx\x00y Ω", "de", "b", 20),
    (7, "mail a@b.co ip 10.0.0.1, 4111 1111 1111 1111 +1 (222) 555-2966", "en", "b", 60),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, odd):
    for table in (docs, odd):
        texts = Counter((r["doc_id"], *brute_counts(r["text"])) for r in table.collect())
        found = Counter(tuple(r)[:6] for r in quality.assess(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert found == texts


def test_quality_verdict(spark):
    random.seed(4)
    rows = []
    for i in range(400):
        words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9))) for _ in range(random.randint(60, 200))]
        if i % 40 == 0:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 2}", 0))
    found = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(not found[i]["kept"] for i in range(0, 400, 40))
    assert sum(found[i]["kept"] for i in range(400) if i % 40) >= 385
    assert all(not r["base_failed"] for r in found.values())


def best_determinant(x, floors, starts=200, seed=0):
    """The least log determinant that concentration from many random subsets finds, each step over exactly the closest rows."""
    rng, best = np.random.default_rng(seed), math.inf
    take = math.ceil(quality.CORE * len(x))
    scatter = lambda core: quality.raised((np.cov(core.T, bias=True) * quality.consistency(quality.CORE))[None], floors)[0]
    for _ in range(starts):
        core, before = x[rng.choice(len(x), 6, replace=False)], math.inf
        for _ in range(50):
            now = np.linalg.slogdet(scatter(core))[1]
            if len(core) == take and now >= before - 1e-9:
                break
            before = now if len(core) == take else math.inf
            gap = x - core.mean(0)
            d = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(scatter(core)), gap)
            core = x[np.argsort(d, kind="stable")[:take]]
        best = min(best, before)
    return best


def test_quality_finds_the_least_determinant(spark):
    """Two groups, one with a quarter of outliers in a cluster, against random starts in memory; small groups ask their language."""
    random.seed(5)

    def text(kind, n):
        if kind == "far":
            return " ".join("verylongwordindeed" + str(random.randint(0, 300)) + "##" for _ in range(n))
        return " ".join(random.choice(["ab", "cde", "fghij", "k#"]) + str(random.randint(0, 400)) * random.randint(1, 3) for _ in range(n))

    rows = [(i, text("near", random.randint(60, 200)), "en", "s", 0) for i in range(240)]
    rows += [(1000 + i, text("far" if i % 5 == 0 else "near", 90), "en", "t", 0) for i in range(150)]
    rows += [(2000 + i, text("near", 80), "en", "small", 0) for i in range(quality.MIN_GROUP - 1)]
    rows += [(3000 + i, text("near", 80), "few", "u", 0) for i in range(3)]
    stats = quality.with_counts(spark.createDataFrame(rows, DOCS), ["doc_id", "lang", "source"]).cache()
    marked = quality._grouped(stats).where("not base_failed").collect()
    vectors = {}
    for r in marked:
        for g in (r["g"], r["g_lang"], r["g_all"]):
            vectors.setdefault(g, []).append([r[x] for x in quality.FEATURES])
    edge = lambda v: (np.sort(np.floor(np.array(v) * 100))[math.ceil(len(v) / 2) - 1] + 1) / 100
    large = {g: np.array(v) for g, v in vectors.items() if len(v) >= quality.MIN_GROUP}
    apart = sum(np.abs(v - [edge(v[:, i]) for i in range(4)]).sum(0) for v in large.values()) / sum(map(len, large.values()))
    n, lines = (math.exp(edge(np.log([r[c] for r in marked]))) for c in ("n_words", "n_lines"))
    floors = np.maximum(math.sqrt(math.pi / 2) * apart, [0, math.log(1 + 20 / n), math.log(1 + 10 / lines), math.log(1 + 60 / n)])
    params = {r["g"]: r for r in quality.learn(stats).collect()}
    assert set(params) == set(large) and len(params) == 4
    for g, r in params.items():
        x = np.array(vectors[g])
        assert r["log_det"] <= best_determinant(x, floors) + 0.05
        d = np.einsum("ij,jk,ik->i", x - r["center"], np.reshape(r["inverse"], (4, 4)), x - r["center"])
        assert np.median(d) < 8  # most rows lie near
    found = {r["doc_id"]: r for r in quality.verdict(stats, quality.learn(stats)).collect()}
    assert all(not found[1000 + i]["kept"] for i in range(0, 150, 5)) and sum(not r["kept"] for d, r in found.items() if d < 1000) <= 6
    for d, g in ((2000, "en"), (3000, "")):
        r = found[d]
        mark = next(m for m in marked if m["doc_id"] == d)
        own = params[mark["g_lang"] if g else mark["g_all"]]
        gap = np.array([mark[x] for x in quality.FEATURES]) - own["center"]
        assert math.isclose(r["distance"], gap @ np.reshape(own["inverse"], (4, 4)) @ gap, rel_tol=1e-6, abs_tol=1e-9)


def test_quality_without_an_estimate(spark):
    rows = [(i, "word " * 10 + " ".join(f"w{j}" for j in range(60)), "en", "s", 0) for i in range(5)]
    assert all(r["kept"] and r["distance"] is None for r in quality.assess(spark.createDataFrame(rows, DOCS)).collect())
    same = quality.assess(spark.createDataFrame(rows * 10, DOCS)).collect()  # no statistic has a spread
    assert len(same) == 50 and all(r["kept"] and r["distance"] < 1e-9 for r in same)


def test_quality_empty_and_extra_columns(empty, odd):
    assert quality.assess(empty).count() == 0 and quality.keep_good(empty).count() == 0
    good = spark_free_text()
    clash = odd.unionByName(odd.sparkSession.createDataFrame([(50, good, "en", "a", 1)], DOCS)).withColumns({c: F.lit(2) for c in CLASHING})
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns and [r["doc_id"] for r in kept.collect()] == [50] and kept.first()["_row"] == 2


CLASHING = ("kept", "g", "g_all", "center", "n_words", "_row", "row", "s", "_s", "_weight", "_hash", "_id", "_none", "fp", "_text", "spans", "a.b", "root", "block")


def spark_free_text():
    return " ".join(f"word{i}" for i in range(60))


def test_stage_functions_keep_clashing_columns(odd):
    """Whatever extra columns are named, the filters, the redaction and the mixing return them with their values."""
    clash = odd.withColumns({c: F.lit(2) for c in CLASHING})
    rows = lambda df: sorted(map(str, df.collect()))
    one = simhash.keep_one(clash)
    assert one.columns == clash.columns and all(r[f"{c}"] == 2 for r in one.collect() for c in CLASHING)
    near = nearcopies.keep_one(clash)
    assert near.columns == clash.columns and all(r[c] == 2 for r in near.collect() for c in CLASHING)
    clean = pii.redacted(clash)
    assert clean.columns == clash.columns and rows(clean.select("doc_id", "text")) == rows(pii.redacted(odd).select("doc_id", "text"))
    mixed = mixing.mix(clash)
    assert mixed.columns == [*clash.columns, "_n_tokens", "_epoch", "_position"] and mixed.where("_weight = 2").count() == mixed.count() >= odd.count()
    packed = packing.pack(clash, tokenizer_path(WORD_BPE), 2)
    assert packed.where("start = 0").count() == odd.count()


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_spans_are_the_patterns():
    random.seed(1)
    for _ in range(4000):
        alphabet = random.choice(["0123456789.+ -()@ab", "01.", "a@b.c-é", "+12 34(5)-.6", "4111 -@.x"])
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))
        if random.random() < 0.3:
            text += " 4111111111111111 x 4111-1111 1111 1111 +1 (222) 555-2966"
        assert [s for s in pii.spans(text) if s[0] < 4] == brute_spans(text)


def test_pii_added_spans_and_redaction(odd, empty):
    text = "IBAN DE89 3704 0044 0532 0130 00, account no: 12345678, http://u:pw@host.org/ and DE00 3704 0044 0532 0130 00"
    kinds = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.spans(text)]
    assert ("account", "DE89 3704 0044 0532 0130 00") in kinds and ("account", "12345678") in kinds and ("login", "u:pw") in kinds
    assert not any("DE00" in x for _, x in kinds)
    zeros = "0" * 5000
    long = f"{zeros}1.1.1.1 {zeros}.0.0.0 1.2.3.{zeros}256 {zeros}4111111111111111"
    assert [(k, long[a:b]) for k, a, b in pii.spans(long)] == [(1, f"{zeros}1.1.1.1"), (1, f"{zeros}.0.0.0")]
    found = {r["doc_id"]: r["text"] for r in pii.redacted(odd).collect()}
    assert found[7] == "mail [EMAIL] ip [IP], [CARD] [PHONE]" and found[1] is None and found[2] == "" and found[5] == LONG
    assert pii.find(empty, ["doc_id"]).count() == 0
    row = pii.find(odd, ["doc_id"]).where("doc_id = 1").first()
    assert row["base_sha256"] == hashlib.sha256(b"").hexdigest() and row["spans"] == ""


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs, odd):
    variants = docs.limit(30).selectExpr("doc_id + 5000 as doc_id", "concat(text, ' tail') as text", "lang", "source", "n_chars")
    table = docs.unionByName(variants).unionByName(odd)
    found = simhash.near_duplicates(table).select("doc_id", simhash.hex16("fp").alias("fp"), "component_id").collect()
    rows = table.collect()
    prints = Counter((r["doc_id"], f"{brute_fingerprint(r['text']):016x}") for r in rows)
    assert Counter((r["doc_id"], r["fp"]) for r in found) == prints
    parent = {f: f for _, f in prints}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 2:
                parent[top(a)] = top(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[top(f)] = min(least.get(top(f), d), d)
    assert all(r["component_id"] == least.get(top(r["fp"])) for r in found)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns and kept.count() == len({top(f) for f in distinct})


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (500, 501), (501, 500), (-3, 500)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 180))
    assert found[500] == found[501] == found[-3] == -3 and len(found) == 61 + 80 + 3


def test_language_mixture(docs, odd, empty):
    found = {r["doc_id"]: r for r in langid.held_out_predictions(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [d for d in found if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(found[d]["held_out"] == (d in set(held)) for d in found)
    assert sum(found[d]["lang_pred"] == truth[d] for d in held) >= 0.95 * len(held)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    by = {x: " ".join(r["text"] for r in docs.where(F.col("lang") == x).limit(3).collect())[:4000] for x in ("en", "de")}
    share = dict(zip(model.languages, model.proportions(langid.trigrams(by["en"] + " " + by["de"]))))
    assert abs(share["en"] - 0.5) < 0.1 and abs(share["de"] - 0.5) < 0.1
    assert sum(model.proportions(langid.trigrams(by["en"])) > 0) == 1
    odd_found = {r["doc_id"]: r for r in langid.held_out_predictions(odd).collect()}
    assert [odd_found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and odd_found[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in odd_found.values())
    assert langid.held_out_predictions(empty).count() == 0
    unlabelled = docs.limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.held_out_predictions(unlabelled).collect()} == {"und"}


def dense(model):
    """The model's probabilities as a table of buckets and languages."""
    found = np.repeat(model.common[:, None], len(model.languages), 1)
    found[np.repeat(np.arange(langid.BUCKETS), np.diff(model.starts)), model.lang] += model.own
    return found


def test_a_thousand_languages(spark):
    """Each has words of its own and some that all have; none is refused, and mixtures of two are told."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßñçéèåøœæłžšđþðαβγδεζηθικλμνξοπρστυφχψω"
    own = {f"l{k:04d}": ["".join(rng.choice(letters) for _ in range(7)) for _ in range(12)] for k in range(1000)}
    say = lambda lang, n: " ".join(rng.choice(own[lang] + ["common", "words"]) for _ in range(n))
    rows = [(k, say(lang, 40), lang, None, 0) for k, lang in enumerate(own)]
    rows += [(5000 + k, say(lang, 40), None, None, 0) for k, lang in enumerate(own)]
    table = spark.createDataFrame(rows, DOCS)
    model = langid.train(table.where("lang IS NOT NULL").select("doc_id", "text", "lang"))
    assert len(model.languages) == 1000 and np.allclose(dense(model).sum(0), 1)
    found = {r["doc_id"]: r for r in langid.predict(table, model, ["doc_id"]).collect()}
    assert sum(found[5000 + k]["lang_pred"] == lang for k, lang in enumerate(own)) >= 995
    share = model.proportions(langid.trigrams(say("l0007", 80) + " " + say("l0900", 40)))
    assert np.argsort(-share)[:2].tolist() == [7, 900] and 0.5 < share[7] < 0.78 and share[7] + share[900] > 0.85


def test_language_set_is_the_best_of_all_sets(docs):
    """Every set of languages by expectation-maximisation, penalised by its size, against the set that is grown."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    by = {x: " ".join(r["text"] for r in docs.where(F.col("lang") == x).limit(3).collect()) for x in model.languages}
    texts = [by[x][:900] for x in by] + [by[a][:1500] + " " + by[b][:1500] for a in by for b in by if a < b] + ["ab", "Ωω " * 20, " ".join(by[x][:2000] for x in by)]
    for text in texts:
        found = langid.trigrams(text)
        kinds, times = np.unique(found, return_counts=True)
        p, n = dense(model)[kinds], len(found)
        penalty = langid.PENALTY * 0.5 * np.log(n + 1)
        scored = {}
        for code in range(1, 1 << len(model.languages)):
            chosen = [i for i in range(len(model.languages)) if code >> i & 1]
            scored[tuple(chosen)] = model._em(p[:, chosen], times.astype(float), n, np.full(len(chosen), 1 / len(chosen)))[1] - penalty * (len(chosen) - 1)
        own = tuple(np.flatnonzero(model.proportions(found)).tolist())
        assert scored[own] >= max(scored.values()) - 0.05 * penalty


def test_equal_proportions_go_to_the_first_language():
    counts = np.ones((3, langid.BUCKETS))
    share = langid.Model(["a", "b", "c"], *(x.astype(np.int64) for x in np.nonzero(counts)), counts[np.nonzero(counts)]).proportions(langid.trigrams("some words here"))
    assert share.tolist() == [1.0, 0.0, 0.0]


def brute_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def test_class_model(docs, odd):
    """Counts and both scores against plain Python, with null ids, repeated rows and unknown words."""
    table = docs.limit(150).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000)).withColumns({"h": F.lit(1), "chain": F.lit("x"), "a.b": F.lit(2)})
    rows = [(r["doc_id"], [*brute_words(r["text"]), None]) for r in table.select("doc_id", "text").collect()]
    in_training = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1
    counts = Counter(w for d, ws in rows if in_training(d) for w in ws)
    total, divisor = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    train = table.where(classlm.crc_fold(5) != 1).select(classlm.utf8().alias("_text"))
    model, rest = classlm.learn(train)
    rare = {r["h"]: (r["n"], r["c"]) for r in rest.collect()}
    signed = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64))
    of, k = {}, classlm.CLASSES + 1
    for w, n in counts.items():
        if w is None:
            of[w] = classlm.END
        elif n >= classlm.LEAST:
            of[w] = int(model.of[model.words(np.array([xxhash.xxh64_intdigest(w)], np.uint64))[0]])
        else:
            assert rare[signed(w)][0] == n
            of[w] = rare[signed(w)][1]
    assert len(rare) == sum(n < classlm.LEAST and w is not None for w, n in counts.items()) and set(of.values()) <= set(range(k))
    mass, once, joint = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for w, n in counts.items():
        mass[of[w]] += n + 0.5
        once[of[w]] += n == 1 and w is not None
    slot = 0.5 + 0.5 * once
    mass += slot
    for d, ws in rows:
        if in_training(d):
            for a, b in zip([None, *ws], ws):
                joint[of[a], of[b]] += 1
    given = (joint + classlm.PRIOR * mass / mass.sum()) / (joint.sum(1, keepdims=True) + classlm.PRIOR)
    given = np.vstack([given, (once / once.sum()) @ given])
    want = Counter()
    for d, ws in rows:
        base = score = 0.0
        before = classlm.END
        for w in ws:
            base += math.log10((counts[w] + 0.5) / divisor)
            score += math.log10(given[before, of[w]] * (counts[w] + 0.5) / mass[of[w]] if counts[w] else given[before] @ (slot / mass))
            before = of[w] if counts[w] else k
        want[d, not in_training(d), len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 4), round(score, 3), round(math.log(10 ** (-score / len(ws))), 3)] += 1
    found = classlm.held_out_scores(table).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4), round(r["score"], 3), round(math.log(r["perplexity"]), 3)) for r in found) == want
    assert (10 ** model.transitions(joint)[:, :k]).sum(1) == pytest.approx(1)  # classes; and within each, words and the slot:
    assert all(math.isclose(sum(n + 0.5 for w, n in counts.items() if of[w] == c) + slot[c], mass[c]) for c in range(k))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_gains_are_changes_of_the_likelihood():
    rng = np.random.default_rng(1)
    pairs = rng.poisson(0.7, (31, 31)).astype(float)
    of = np.append(rng.integers(0, 5, 30), classlm.END)
    of[7] = classlm.NONE
    member = np.eye(classlm.ALL)[of]
    joint = member.T @ pairs @ member
    into, out, own = (pairs - np.diag(np.diag(pairs))).T @ member, (pairs - np.diag(np.diag(pairs))) @ member, np.diag(pairs)
    gain = classlm.gains(into, out, own, of, joint)
    for w in range(30):
        for c in (0, 2, 4, 11):
            other = of.copy()
            other[w] = c
            m = np.eye(classlm.ALL)[other]
            assert math.isclose(gain[w, c] - gain[w, of[w]], classlm.likelihood(m.T @ pairs @ m) - classlm.likelihood(joint), abs_tol=1e-6)


def test_sweeps_find_the_classes(monkeypatch, spark):
    """Two kinds of words that take turns; more words than the driver clusters first."""
    random.seed(8)
    texts = []
    for _ in range(400):
        texts.append((bytearray(" ".join(f"{'ab'[i % 2]}{random.randint(0, 399)}" for i in range(random.randint(30, 60))).encode()),))
    train = spark.createDataFrame(texts, "_text binary")
    words = classlm.Words(np.array([xxhash.xxh64_intdigest(f"{k}{i}".encode()) for k in "ab" for i in range(400)], np.uint64))
    near = classlm.neighbours(train, words).cache()
    of, joint = classlm.cluster(near, words.size)
    monkeypatch.setattr(classlm, "LIST", 100)  # frequent words in many rows: the same classes
    split = classlm.neighbours(train, words, 40).cache()
    assert split.groupBy("w").count().where("w < 40 AND count > 2").count() > 30 and split.groupBy("w").count().where("w >= 40 AND w < 800 AND count > 1").count() == 0
    again, joint_again = classlm.cluster(split, words.size, 40)
    assert np.array_equal(of, again) and np.allclose(joint, joint_again)
    random_joint = classlm.class_pairs(near, np.append(np.arange(800) % classlm.CLASSES, [classlm.END, classlm.NONE]).astype(np.uint8))
    assert classlm.likelihood(joint) > classlm.likelihood(random_joint) and np.allclose(joint, classlm.class_pairs(near, of))
    kinds = [Counter(of[:400].tolist()), Counter(of[400:800].tolist())]
    mixed = sum(min(kinds[0][c], kinds[1][c]) for c in range(classlm.CLASSES))
    assert mixed <= 8


def test_neighbours_meet_in_one_exchange(monkeypatch, spark):
    """Neighbours of words, on both sides, against plain counting; tasks' counts are exchanged once, packed."""
    monkeypatch.setattr(classlm, "GROUPS", 7)
    texts = [b"a b a a c", b"b a b", b"", b"c x a y", b"a a a", b"A  b\n"] * 3
    words = classlm.Words(np.array([xxhash.xxh64_intdigest(w) for w in (b"a", b"b", b"c")], np.uint64))
    near = classlm.neighbours(spark.createDataFrame([(bytearray(t),) for t in texts], "_text binary").repartition(3), words, 1)
    want, number = Counter(), {b"a": 0, b"b": 1, b"c": 2}
    for t in texts:
        ids = [3, *(number.get(w, 4) for w in t.lower().split()), 3]
        for a, b in zip(ids, ids[1:]):
            want[a, b] += 1
            if b < 3:
                want[b, -1 - a] += 1
    found = Counter()
    for r in near.collect():
        for v, n in zip(np.frombuffer(r["v"], np.int32).tolist(), np.frombuffer(r["n"], np.float64).tolist()):
            assert (r["w"], v) not in found
            found[r["w"], v] = n
    assert found == want
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Aggregate" not in plan and "RepartitionByExpression" not in plan


def test_words_are_found_by_leading_bits():
    rng = np.random.default_rng(5)
    h = np.unique(np.concatenate([rng.integers(0, 1 << 64, 3000, np.uint64), np.arange(500, dtype=np.uint64), np.arange(500, dtype=np.uint64) + np.uint64((1 << 64) - 500)]))
    rng.shuffle(h)
    words = classlm.Words(h)
    other = np.setdiff1d(np.concatenate([rng.integers(0, 1 << 64, 3000, np.uint64), np.array([700, (1 << 64) - 600], np.uint64)]), h)
    assert np.array_equal(words(h), np.arange(len(h))) and (words(other) == len(h) + 1).all() and words(np.array([classlm.END_HASH], np.uint64)).tolist() == [len(h)]
    assert classlm.Words(np.empty(0, np.uint64))(np.array([classlm.END_HASH, 0, (1 << 64) - 1], np.uint64)).tolist() == [0, 1, 1]


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(3)
    pairs = np.zeros((21, 21))
    for a in range(20):
        for b in range(20):
            pairs[a, b] = rng.poisson(30 if (a % 2) != (b % 2) else 1)
    pairs[20, :] = pairs[:, 20] = 1
    of = classlm.exchange(pairs, classes=2)
    assert len({of[i] for i in range(0, 20, 2)}) == 1 and len({of[i] for i in range(1, 20, 2)}) == 1 and of[20] == classlm.END


def test_class_model_empty(empty):
    assert classlm.held_out_scores(empty).count() == 0
