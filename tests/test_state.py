"""Stores, streams with state and live pastes: batches in any number and order end alike, and equal their batch forms."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.inline import inline_html, inline_nodes
from quillon.operators import styles
from quillon.sources import tables
from quillon.streaming import outcomes, pastes, profiles, shortcuts
from quillon.streaming.store import Store

NOW = dt.datetime(2024, 5, 1, 12)


def at(seconds):
    return NOW + dt.timedelta(seconds=seconds)


def stream(spark, folder, batches, schema):
    """A stream that gives each of ``batches`` in a batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getctime)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def finished(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


# -- marks in marks


def test_marks_to_any_depth_and_odd_characters(spark):
    cases = {
        "_a **b ~~c __d *e `f`* d__ c~~ b** a_": None,  # an underscore encloses none of its kind
        "**a *b ~~c __d _e `f`_ d__ c~~ b* a**": "<strong>a </strong><strong><em>b </em></strong><strong><em><s>c </s></em></strong><strong><em><s>d </s></em></strong><strong><em><s>e </s></em></strong><strong><em><s><code>f</code></s></em></strong><strong><em><s> d</s></em></strong><strong><em><s> c</s></em></strong><strong><em> b</em></strong><strong> a</strong>",
        "a﷐b **c** ﷐": "a﷐b <strong>c</strong> ﷐",
        "** a**": "** a**",
        "`**`": "<code>**</code>",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", inline_html("t", F.lit(True)).alias("h"), inline_nodes("t", F.lit(True)).alias("n")).collect()
    for r in rows:
        if cases[r["t"]] is not None:
            assert r["h"] == cases[r["t"]]
        assert "".join(n["text"] for n in r["n"]).count("f") == r["t"].count("f")
    deep = next(r for r in rows if r["t"].startswith("**a"))
    assert sum(n["emphasis"] for n in deep["n"]) == 6


# -- the store

SCHEMA = "k bigint, at bigint, v string"


def brute(batches):
    held = {}
    for rows in batches:
        for k, t, v, gone in rows:
            if k not in held or t >= held[k][0]:
                held[k] = (t, v, gone)
    return {k: (t, v) for k, (t, v, gone) in held.items() if not gone}


def test_store_equals_brute_force_at_every_version(spark, tmp_path):
    rng = random.Random(1)
    schema = spark.createDataFrame([], SCHEMA).schema
    store = Store(spark, f"file://{tmp_path}/s", schema, ("k",), ("at",), buckets=4, most_deltas=2)
    assert store.version() == -1 and store.read().count() == 0
    batches, clock = [], 0
    for _ in range(6):
        rows = []
        for k in rng.sample([*range(12), None], 3):
            clock += 1
            rows.append((k, clock, rng.choice("abc"), rng.random() < 0.2))
        batches.append(rows)
        store.write(spark.createDataFrame(rows, SCHEMA + ", g boolean"), gone="g")
    assert store.write(spark.createDataFrame([], SCHEMA), version=6) == 6  # an empty batch is a version as well
    for version in range(6):
        found = {r["k"]: (r["at"], r["v"]) for r in store.read(version).collect()}
        assert found == brute(batches[: version + 1])
    for since, until in ((-1, 5), (0, 3), (2, 6), (3, 3)):
        old, new = brute(batches[: since + 1]), brute(batches[: min(until, 5) + 1])
        expected = {k: ("insert" if k not in old else "delete" if k not in new else "update", old.get(k), new.get(k)) for k in {*old, *new} if old.get(k) != new.get(k)}
        pair = lambda r: r and (r["at"], r["v"])
        assert {r["k"]: (r["change"], pair(r["before"]), pair(r["after"])) for r in store.changes(since, until).collect()} == expected


def files_below(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    store = Store(spark, f"file://{tmp_path}/s", schema, ("k",), ("at",), buckets=8, most_deltas=2)
    store.write(spark.createDataFrame([(k, 0, "x") for k in range(100)], SCHEMA))
    before = files_below(tmp_path / "s")
    for t in (1, 2, 3):
        store.write(spark.createDataFrame([(7, t, "y")], SCHEMA))
    after = files_below(tmp_path / "s")
    assert all(after[f] == when for f, when in before.items())
    touched = {part for f in after.keys() - before.keys() for part in f.split("/") if part.startswith("bucket=")}
    assert len(touched) == 1 and any("/bases/" in f for f in after)
    assert {b for b, _, v in store.log() if v > 0} == {int(next(iter(touched)).split("=")[1])}
    # a version that is committed is not written again
    assert store.write(spark.createDataFrame([(7, 9, "z")], SCHEMA), version=2) == 2 and store.read().where("k = 7").first()["v"] == "y"
    # nor does a half-written one count
    (tmp_path / "s/deltas/version=4/bucket=0").mkdir(parents=True)
    assert store.version() == 3 and store.read().count() == 100


def test_the_last_writer_wins_without_an_order(spark, tmp_path):
    schema = spark.createDataFrame([], "k bigint, v string").schema
    store = Store(spark, f"file://{tmp_path}/s", schema, ("k",), buckets=2)
    query = store.follow(stream(spark, str(tmp_path / "in"), [[(1, "z"), (2, "a")], [(1, "b")], [(2, "c")]], schema), f"file://{tmp_path}/c")
    finished(query)
    assert sorted(map(tuple, store.read().collect())) == [(1, "b"), (2, "c")] and store.version() == 2


# -- styles

EVENTS = "scope string, at timestamp, seq bigint, action string, heading string, entry string, bullet string, body string"


def test_profiles_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for n in range(60):
        action = rng.choice(["auto"] * 5 + ["replace", "forget"])
        taught = [None] * 4 if action == "forget" else [rng.choice([None, f"{r}{n}"]) for r in "hebp"]
        rows.append((rng.choice("stu"), at(rng.randrange(3000)), n, action, *taught))
    expected = sorted(map(tuple, profiles.profiles_of(spark.createDataFrame(rows, EVENTS)).drop("at", "seq").collect()))
    for batches in (1, 5):
        folder = tmp_path / str(batches)
        found = profiles.profile_stream(stream(spark, str(folder / "in"), [rows[k::batches] for k in range(batches)], spark.createDataFrame([], EVENTS).schema))
        store = Store(spark, f"file://{folder}/s", found.drop("gone").schema, ("scope",), buckets=2)
        finished(store.follow(found, f"file://{folder}/c", "gone", "update"))
        assert sorted(map(tuple, store.read().drop("at", "seq").collect())) == expected


def test_profiles_are_forgotten_after_long_silence(spark, tmp_path):
    rows = [[("s", at(0), 1, "auto", "h", None, None, None)], [("t", at(40 * 86400), 2, "auto", None, None, "b", None)], [("t", at(41 * 86400), 3, "auto", None, None, None, "x")]]
    found = profiles.profile_stream(stream(spark, str(tmp_path / "in"), rows, spark.createDataFrame([], EVENTS).schema), keep_days=30)
    store = Store(spark, f"file://{tmp_path}/s", found.drop("gone").schema, ("scope",), buckets=2)
    finished(store.follow(found, f"file://{tmp_path}/c", "gone", "update"))
    assert [tuple(r)[:1] + tuple(r)[3:] for r in store.read().collect()] == [("t", None, None, "b", "x")]


def test_samples_of_a_copy_stream_teach_what_they_teach_in_a_table(spark, tmp_path):
    mark = "<b id='docs-internal-guid-1'></b>"
    copies = [
        ("gdoc:a", at(1), mark + "<h2 style='color:#1f3a8a'>SKILLS</h2><p style='font-size:11pt'>Body text of some length.</p>"),
        ("gdoc:a", at(2), mark + "<p style='font-size:9pt'>Another, longer body text of some length.</p><ul><li>x</li></ul>"),
        ("gdoc:a", at(3), "<h2>NO MARK</h2>"),
        (None, at(4), mark + "<h2>NO SCOPE</h2>"),
        ("gdoc:b", at(5), mark + "<h2>OTHER</h2>"),
    ]
    table = spark.createDataFrame(copies, "scope string, at timestamp, html string")
    samples = profiles.style_samples(table)
    assert samples.count() == 3
    expected = styles.merged(styles.learn(samples.withColumn("at", F.unix_micros("at"))))
    store = Store(spark, f"file://{tmp_path}/s", spark.createDataFrame([], "scope string, at bigint, seq bigint, heading string, entry string, bullet string, body string").schema, ("scope",), buckets=2)
    taught = str(tmp_path / "taught")

    def learn(batch, number):
        profiles.taught(batch).write.mode("overwrite").parquet(f"file://{taught}/batch={number}")

    source = profiles.style_samples(stream(spark, str(tmp_path / "in"), [copies[:1], copies[1:3], copies[3:]], table.schema))
    finished(source.writeStream.foreachBatch(learn).option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start())
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{taught}/batch=*")
    finished(store.follow(profiles.profile_stream(events), f"file://{tmp_path}/c2", "gone", "update"))
    said = lambda df: sorted((r["scope"], *[r[k] for k in styles.ROLES]) for r in df.collect())
    assert said(store.read()) == said(expected.select("scope", *[F.to_json(r).alias(r) for r in styles.ROLES]))


class Held:
    """A state of one value, with the calls to it; it is its own handle and clock."""

    def __init__(self):
        self.value, self.calls, self.clock = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")

    def registerTimer(self, at):
        self.calls.append(at)

    def getCurrentWatermarkInMs(self):
        return self.clock


@pytest.mark.parametrize("processor, row", [(profiles._Profiles(("a",), 100), {"seq": 1, "action": "auto", "a": "x"}), (outcomes._Ring(5, 100), {"id": 1, "what": "x"})])
def test_a_batch_reads_and_writes_the_state_of_a_key_once(processor, row):
    held = Held()
    processor.init(held)
    for ms in (0, 50):  # the timer is set once, and moved when it fires
        assert [r["gone"] for r in processor.handleInputRows(("k",), iter([row | {"at": ms * 1000}] * 3), held)] == [False]
    assert held.calls == ["get", 100, "update", "get", "update"]
    held.clock = 120
    assert list(processor.handleExpiredTimer(("k",), held, None)) == [] and held.calls[5:] == ["get", 150]
    held.clock = 150
    assert [r["gone"] for r in processor.handleExpiredTimer(("k",), held, None)] == [True] and held.calls[7:] == ["get", "clear"]


# -- shortcuts and outcomes


def test_suppression_by_stream_and_table(spark, tmp_path):
    rng = random.Random(6)
    pasted = [(n, rng.choice([1, 2, None]), at(rng.randrange(60_000) / 1000)) for n in range(80)]
    pressed = [(rng.choice([1, 2, None]), at(rng.randrange(60_000) / 1000)) for _ in range(60)] + [(1, pasted[0][2]), (1, at(100)), (1, at(100))]
    pasted += [(900, 1, at(100)), (901, 1, at(100.999)), (902, 1, at(101)), (903, 1, at(99.999)), (900, 1, at(100))]
    second = dt.timedelta(seconds=1)
    expected = {i: any(u is not None and u == v and p <= t and p > t - second for v, p in pressed) for i, u, t in pasted}
    assert expected[901] and not expected[902] and not expected[903]
    p_schema, s_schema = "paste_id bigint, user_id bigint, ts timestamp", "user_id bigint, ts timestamp"
    batch = shortcuts.with_suppression(spark.createDataFrame(pasted, p_schema), spark.createDataFrame(pressed, s_schema))
    assert {r["paste_id"]: r["suppressed"] for r in batch.collect()} == expected and batch.count() == len(expected)
    end = at(9e6)
    left = stream(spark, str(tmp_path / "p"), [pasted[:40], pasted[40:], [(-1, -1, end)]], spark.createDataFrame([], p_schema).schema)
    right = stream(spark, str(tmp_path / "s"), [pressed[:30], pressed[30:], [(-1, end)]], spark.createDataFrame([], s_schema).schema)
    query = shortcuts.with_suppression(left, right).writeStream.format("memory").queryName("suppressed").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    finished(query)
    found = [r for r in spark.table("suppressed").collect() if r["paste_id"] >= 0]
    assert {r["paste_id"]: r["suppressed"] for r in found} == expected and len(found) == len(expected)


@pytest.mark.parametrize("batches", [1, 4])
def test_rings_and_newest_keys(spark, tmp_path, batches):
    rng = random.Random(8)
    rows = [(rng.randrange(6), at(rng.randrange(2000)), n, rng.choice("ab")) for n in range(70)]
    rows += rows[:5]  # rows that come again
    schema = spark.createDataFrame([], "key bigint, ts timestamp, id bigint, what string").schema
    parts = [rows[k::batches] for k in range(batches)]
    found = outcomes.ring_stream(stream(spark, str(tmp_path / "in"), parts, schema))
    store = Store(spark, f"file://{tmp_path}/s", found.drop("gone").schema, ("key",), buckets=2)
    finished(store.follow(found, f"file://{tmp_path}/c", "gone", "update"))
    newest = {k: sorted({(t, n, w) for j, t, n, w in rows if j == k}, reverse=True)[:5] for k in {r[0] for r in rows}}
    assert {r["key"]: [(x["id"], x["what"]) for x in r["ring"]] for r in store.read().collect()} == {k: [x[1:] for x in v] for k, v in newest.items()}
    path = f"file://{tmp_path}/n"
    finished(outcomes.follow_newest(stream(spark, str(tmp_path / "in2"), parts, schema), path, f"file://{tmp_path}/c2", "key", "ts", "id", n=3))
    last = sorted(((v[0][0], v[0][1], k) for k, v in newest.items()), reverse=True)[:3]
    assert sorted((r["key"], r["id"]) for r in outcomes.newest_keys(spark, path).collect()) == sorted((k, n) for _, n, k in last)


# -- live pastes

PASTES = "paste_id bigint, user_id bigint, html string, text string, n_files int, ms_since_shortcut bigint"


def test_live_pastes_meet_the_settings_of_their_batch(spark, tmp_path):
    schema = spark.createDataFrame([], PASTES).schema
    settings = Store(spark, f"file://{tmp_path}/settings", spark.createDataFrame([], "user_id bigint, enabled boolean, destination string").schema, ("user_id",), buckets=2)
    folder, out, checkpoint = str(tmp_path / "in"), f"file://{tmp_path}/out", f"file://{tmp_path}/c"
    text = "A  word ​and **bold**"
    finished(pastes.clean_stream(stream(spark, folder, [[(1, 1, None, text, 0, None)]], schema), settings, out, checkpoint))
    settings.write(spark.createDataFrame([(2, False, None), (3, None, "plain")], settings.schema))
    rows = [(2, 1, None, text, None, None), (3, 2, None, text, None, None), (4, 3, None, "a  b", None, None), (5, 3, None, text, None, 900), (6, 1, None, None, 2, None), (7, 1, "<!--quillon:cleaned--><p>x  y</p>", None, None, None), (8, 1, None, "clean", None, None), (9, 1, None, None, None, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    finished(pastes.clean_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}"), settings, out, checkpoint))
    found = {r["paste_id"]: r for r in pastes.results(spark, out).collect()}
    reasons = {1: "settings-not-loaded", 2: None, 3: "disabled", 4: None, 5: "plain-paste-shortcut", 6: "files", 7: "already-cleaned", 8: "nothing-to-fix", 9: "no-data"}
    assert {k: r["reason"] for k, r in found.items()} == reasons
    assert found[1]["text"] == text and found[2]["html"] == "<p>A word and **bold**</p>" or "<strong>bold</strong>" in found[2]["html"]
    assert found[4]["text"] == "a b" and found[4]["html"] is None and found[4]["fixes"] == 1 and found[3]["fixes"] == 0
    assert found[2]["title"] == "Pasted cleanly" and found[2]["settings"] == 0 and found[1]["settings"] == -1
    # a batch that comes again meets the settings it met at first
    settings.write(spark.createDataFrame([(1, False, None)], settings.schema))
    before = sorted(map(str, found.values()))
    for f in ("commits/1", "commits/.1.crc"):
        if (tmp_path / "c" / f).exists():
            (tmp_path / "c" / f).unlink()
    finished(pastes.clean_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}"), settings, out, checkpoint))
    assert sorted(map(str, pastes.results(spark, out).collect())) == before


def test_large_batches_of_pastes_are_joined_in_more_partitions(monkeypatch, spark):
    rows = spark.createDataFrame([(i, i % 3, None, f"a  {i}", None, 500 if i % 5 == 0 else None) for i in range(60)], PASTES)
    held = spark.createDataFrame([(0, True, "plain"), (1, False, None)], "user_id bigint, enabled boolean, destination string")
    monkeypatch.setattr(tables, "DEALT", 2048)
    cleaned = pastes._cleaned(rows, held, 0)
    assert cleaned.rdd.getNumPartitions() == tables.partitions_of(rows, "html", "text") == 8
    found = {r["paste_id"]: (r["reason"], r["text"]) for r in cleaned.collect()}
    assert found == {i: ("disabled", f"a  {i}") if i % 3 == 1 else ("plain-paste-shortcut", f"a  {i}") if i % 5 == 0 else (None, f"a {i}") for i in range(60)}


def test_items_become_one_payload(spark):
    items = [(1, 2, "<p>b</p>", "b"), (1, 1, None, "a"), (1, 3, "<p>c</p>", None), (2, 1, None, None), (None, 1, "x", "y"), (1, 1, None, "a")]
    found = pastes.clipboard_items(spark.createDataFrame(items, "id bigint, position int, html string, text string"), "id").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, "<p>b</p>", "a"), (2, None, None), (None, "x", "y")], key=str)
