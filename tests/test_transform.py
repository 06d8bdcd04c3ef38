"""Payloads with one flaw each, and what becomes of them."""

import datetime
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon import queries as clipboard
from quillon.functions import detect, links, text
from quillon.operators import lines, linescan, markup, relational, runs, styles, tables
from quillon.operators.units import scanned
from quillon.plans.transform import _scan, sources, transform
from quillon.sources.tables import partitions_of
from quillon.streaming.attribution import attribute_stream

SCHEMA = "id string, html string, text string"
WRAPPED = "This is a long line of a paragraph that was broken produc-\ntivity by a narrow column and goes on for some time here\nuntil it ends.\nTitle Here\n\n\n\nPage 2 of 3\nvisit https://x.org now."


MARKDOWN = "# Title\n\nHello **bold** and [site](https://x.org/a).\n- one\n  - two\n- three\n\n1. x\n2. y\n\n```\ncode **x**\n```\n> quoted"
PAGE = "<style>p{}</style><p>Hi <b>there<p>still <a href='javascript:x()'>bad</a> <a href=\"https://a.b/c\">good</a></p><script>var a='</p>';</script><ul><li>one<li>two</ul><h2>Head</h2>"
#: Flavours of the payloads that the tests below ask for; one Spark job makes all their results.
PAYLOADS = [{"text": t} for t in (MARKDOWN, "# A\n\nb **c**", "Name\tAge\nAnn\t3\nBob\t14", WRAPPED, " \n\t ", "a" * 1_000_001, "Page 3 of 4", "One paragraph.\n\nAnother one.")] + [{"html": PAGE}, {}]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(str(i), p.get("html"), p.get("text")) for i, p in enumerate(PAYLOADS)]
    return {(int(r["id"]), r["destination"]): r for r in transform(spark.createDataFrame(rows, SCHEMA), "rich", "plain", "gmail", "slack").collect()}


def run(found, destination, **payload):
    return found[PAYLOADS.index(payload), destination]


def notes(row):
    return {n["note"]: n["count"] for n in row["notes"]}


def test_markdown(found):
    source = MARKDOWN
    rich = run(found, "rich", text=source)
    assert rich["html"] == (
        '<h1>Title</h1><p>Hello <strong>bold</strong> and <a href="https://x.org/a">site</a>.</p><ul><li>one<ul><li>two</li></ul></li><li>three</li></ul>'
        "<ol><li>x</li><li>y</li></ol><pre><code>code **x**</code></pre><blockquote><p>quoted</p></blockquote>"
    )
    assert rich["changed"] and {"md-lists", "md-headings", "md-emphasis", "md-links"} <= set(notes(rich))
    plain = run(found, "plain", text=source)
    assert plain["html"] is None and plain["text"].startswith("# Title\n\nHello **bold**") and "kept-markdown" in notes(plain)


def test_mail_and_chat(found):
    mail = run(found, "gmail", text="# A\n\nb **c**")
    assert mail["html"] == "<div><strong>A</strong></div><div><br></div><div>b <strong>c</strong></div>"
    assert {"headings-flattened": 1, "email-spacing": 1}.items() <= notes(mail).items()
    sheet = run(found, "slack", text="Name\tAge\nAnn\t3\nBob\t14")
    assert sheet["label"] == "Spreadsheet" and sheet["html"] == "<pre>Name  Age\n----  ---\nAnn   3\nBob   14</pre>"
    assert not run(found, "plain", text="Name\tAge\nAnn\t3\nBob\t14")["changed"]


def test_hard_wrapped(found):
    row = run(found, "rich", text=WRAPPED)
    assert row["label"] == "PDF text" and "broken productivity by" in row["html"] and "<p>Title Here</p>" in row["html"] and "Page 2" not in row["text"]
    assert {"page-furniture": 1, "reflow": 1, "dehyphenate": 1, "blank-lines": 2, "links": 1}.items() <= notes(row).items()


def test_html(found):
    row = run(found, "rich", html=PAGE)
    assert row["html"] == '<p>Hi <strong>there</strong></p><p><strong>still bad</strong> <a href="https://a.b/c"><strong>good</strong></a></p><ul><li><strong>one</strong></li><li><strong>two</strong></li></ul><h2>Head</h2>'
    assert {"unsafe": 1, "styles": 1, "links": 1}.items() <= notes(row).items()


@pytest.mark.parametrize(("payload", "reason"), [({}, "empty"), ({"text": " \n\t "}, "empty"), ({"text": "a" * 1_000_001}, "too-large"), ({"text": "Page 3 of 4"}, "unsupported")])
def test_gates(found, payload, reason):
    row = run(found, "rich", **payload)
    assert not row["ok"] and row["reason"] == reason and not row["changed"] and row["html"] is None


def test_odd_payloads(spark):
    rows = [("a", None, "x\x00y"), ("b", "<p>" + "z " * 30_000, None), ("c", "<<<", ">>>"), ("d", None, "\U0001f600 ‫שלום‬ café"), ("e", None, "w" * 200_000)]
    found = transform(spark.createDataFrame(rows, SCHEMA), "gmail", "plain", "nowhere")
    assert found.count() == 15


def test_clean_texts_stay(found):
    row = run(found, "rich", text="One paragraph.\n\nAnother one.")
    assert row["html"] == "<p>One paragraph.</p><p>Another one.</p>" and not row["changed"]


def test_cleanup_is_idempotent(spark):
    t = spark.createDataFrame([("a b​\r\nc  \t d e",)], "t string")
    once = text.collapse_spaces(text.clean_characters("t"))
    row = t.select(once.alias("a"), text.collapse_spaces(text.clean_characters(once)).alias("b")).first()
    assert row["a"] == row["b"] == "a b\nc d\ne"


def test_urls(spark):
    rows = [("https://x.org", True), ("HTTP://x", True), ("javascript:alert(1)", False), ("java\nscript:x", False), ("mailto:a@b", True), ("/relative", False), ("www.x.org", True), ("https://", False), ("data:text/html,x", False)]
    for url, fine in rows:
        assert (spark.createDataFrame([(url,)], "u string").select(links.safe_url("u")).first()[0] is not None) == fine, url
    trimmed = spark.createDataFrame([("see https://a.b/c(d). and (www.x.y/z)!",)], "t string").select(links.bare_urls("t")).first()[0]
    assert trimmed == ["https://a.b/c(d)", "www.x.y/z"]


def test_as_of_takes_the_latest_copy_only(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    copies = spark.createDataFrame([(1, at(0), "a", "s1"), (1, at(5), "b", "s2"), (2, at(0), "a", "s3")], "user_id int, ts timestamp, fingerprint string, site string")
    pastes = spark.createDataFrame([(1, at(4), 10, "a"), (1, at(6), 11, "a"), (1, at(35), 12, "b"), (1, at(36), 13, "b"), (2, at(1), 14, "")], "user_id int, ts timestamp, paste_id bigint, fingerprint string")
    found = {r["paste_id"]: r["origin"] for r in relational.attribute(copies, pastes, ["user_id"]).collect()}
    assert found == {10: "s1", 11: None, 12: "s2", 13: None, 14: None}


def test_stream_agrees_with_batch(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, at(0), 1, False, "a", "s1"), (2, at(4), 1, True, "a", None), (3, at(5), 1, False, "b", "s2"), (4, at(6), 1, True, "a", None), (5, at(35), 1, True, "b", None), (5, at(35), 1, True, "b", None)]
    schema = "event_id bigint, ts timestamp, user_id bigint, is_paste boolean, fingerprint string, site string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = attribute_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = out.writeStream.format("memory").queryName("pasted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["paste_id"]: r["origin"] for r in spark.table("pasted").collect()} == {2: "s1", 4: None, 5: "s2"}


def test_table_rules(spark):
    t = spark.createDataFrame([(["Key\tName", "1", "2\tb|c\td"],)], "l array<string>").withColumn("c", tables.parse_tabs(F.col("l")))
    assert t.select(tables.to_pipes(F.col("c"))).first()[0] == "| Key | Name |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | b\\|c | d |"
    assert t.select(tables.has_header(F.col("c"))).first()[0]
    assert not spark.createDataFrame([([["1", "x"]],)], "c array<array<string>>").select(tables.has_header(F.col("c"))).first()[0]


def test_skip_order(spark):
    facts = {k: F.lit(v) for k, v in {"active": True, "ms_since_shortcut": 5000, "editable": True, "destination": "rich", "has_data": True, "n_files": 0, "html": "", "text": "x", "ok": True, "changed": True, "delivered": True}.items()}
    one = spark.range(1)
    assert one.select(detect.skip_reason(facts)).first()[0] is None
    assert one.select(detect.skip_reason(facts | {"active": F.lit(False), "ok": F.lit(False)})).first()[0] == "disabled"
    assert one.select(detect.skip_reason(facts | {"html": F.lit(detect.CLEANED_MARKER)})).first()[0] == "already-cleaned"


def test_audit_looks_at_tags_alone(spark):
    cases = {
        "<!-- <script>x</script> <font> --><p>a</p>": (False, False), "<p title='<script> onx= style='>a</p>": (False, False), "<p>say onclick=3 style=4 &lt;script></p>": (False, False), "<script>var a='<font color=1>'</script>": (True, False),
        "<p ONCLICK = 'x'>": (True, False), "<a href=' javascript:x'>": (True, False), "<a\nstyle=x>": (False, True), "<p data-x=\"a>b\" class='c'>": (False, True), "x < y style= >": (False, False), "<style>p{ onx=1 }": (False, True),
    }
    found = spark.createDataFrame([(h,) for h in cases], "h string").select("h", *[v.alias(k) for k, v in markup.audit(F.col("h")).items()]).collect()
    assert {r["h"]: (r["unsafe"], r["styles"]) for r in found} == cases


def test_lists_keep_going_behind_blank_lines(spark):
    rows = spark.createDataFrame([(1, ["• a", "", "• b", "1. c"], False)], "key bigint, lines array<string>, markdown boolean")
    found = lines.list_items(linescan.text_units(rows)).orderBy("item").collect()
    assert [(r["content"], r["ordered"], r["depth"], r["block"]) for r in found] == [("a", False, 0, 1), ("b", False, 0, 1), ("c", True, 0, 2)]


def test_levels_are_a_stack_not_a_rank(spark):
    rows = spark.createDataFrame([(1, ["- a", "    - b", "- c", "  - d", "    - e", "  - f"], False)], "key bigint, lines array<string>, markdown boolean")
    found = lines.list_items(linescan.text_units(rows)).orderBy("item").collect()
    assert [r["depth"] for r in found] == [0, 1, 0, 1, 2, 1]


SAMPLE = (
    '<h1 style="font-family:Times New Roman,serif;font-size:13pt;color:#2f4b8c;border-top:1pt solid #aabbcc">PROFILE</h1>'
    '<p style="font-family:Georgia;font-size:12pt;margin-top:3pt;line-height:1.2">A longer line of plain body text that goes on for quite a while.</p>'
    '<p style="font-family:Georgia"><b>Harbor</b>, Coordinator\t<i>Mar 2021 – Jun 2023</i></p>'
    '<ul><li style="font-size:11.5pt;color:url(x)"><p style="font-family:Arial">An item</p></li></ul><p style="display:none">unseen words of a paragraph that is longer than all the others in here</p>'
)


def test_styles_are_learned_and_merged(spark):
    rows = spark.createDataFrame([("doc", 1, SAMPLE), ("doc", 2, '<p style="font-size:9pt">Only a body line of another sample, all plain.</p>'), ("none", 1, "<span>  </span>"), ("bad", 1, None)], "scope string, at bigint, html string")
    profiles = styles.learn(rows)
    first = profiles.where("scope = 'doc' and at = 1").first()
    assert first["heading"]["text"].asDict() == {"fontFamily": "'Times New Roman', serif", "fontSize": "13pt", "color": "#2f4b8c", "bold": True, "italic": False}
    assert first["heading"]["caps"] and first["heading"]["ruleBefore"] and first["heading"]["ruleColor"] == "#aabbcc"
    assert first["entry"]["datesRight"] and first["entry"]["dateItalic"] and not first["entry"]["text"]["bold"]
    assert first["bullet"]["text"]["fontFamily"] == "Arial" and first["bullet"]["text"]["fontSize"] == "11.5pt" and first["bullet"]["text"]["color"] is None
    assert first["body"]["text"]["fontFamily"] == "Georgia" and first["body"]["block"].asDict() == {"marginTop": "3pt", "marginBottom": None, "lineHeight": "1.2"}
    assert {r["scope"] for r in profiles.collect()} == {"doc"}
    stored = styles.upsert(profiles.where("at = 1"), profiles.where("at = 2")).first()
    assert stored["body"]["text"]["fontSize"] == "9pt" and stored["heading"]["caps"] and stored["at"] == 2
    said = profiles.where("at = 1").select(styles.described({r: F.col(r) for r in styles.ROLES}).alias("s")).first()["s"]
    assert said == "Learned headings (all caps, coloured, line above), entries with dates on the right, bullets and text in Georgia 12pt."
    assert styles.forgotten(profiles, spark.createDataFrame([("doc",)], "scope string")).count() == 0


def test_results_in_a_learned_style(spark):
    profile = styles.learn(spark.createDataFrame([("doc", 1, SAMPLE)], "scope string, at bigint, html string")).select("scope", F.struct(*styles.ROLES).alias("style"))
    text = "## Work\n\n**Harbor & Co**, Cook · Mar 2020 to now\n\n- **a** b\n  - c\n\nPlain words.\n\n```\nx<y\n```"
    payloads = spark.createDataFrame([("doc", None, text), ("other", None, text)], SCHEMA).join(profile.withColumnRenamed("scope", "id"), "id", "left")
    found = {(r["id"], r["destination"]): r for r in transform(payloads, "google-docs", "plain").collect()}
    html = found["doc", "google-docs"]["html"]
    assert html.startswith('<hr style="border:none;border-top:1px solid #aabbcc"><p style="margin-top:0pt;margin-bottom:0pt"><span style="font-family:&#39;Times New Roman&#39;, serif;font-size:13pt;color:#2f4b8c;font-weight:700;font-style:normal">WORK</span></p>')
    assert "<strong>Harbor &amp; Co</strong>, Cook</span></p></td>" in html and 'text-align:right"><span style="font-family:Georgia;font-weight:400;font-style:italic">Mar 2020 to now</span>' in html
    assert '<ul style="margin-top:0;margin-bottom:0"><li style="font-family:Arial;font-size:11.5pt;font-weight:400;font-style:normal"><p' in html and "<pre>x&lt;y</pre>" in html
    first = found["doc", "google-docs"]["notes"][0]
    assert (first["note"], first["message"]) == ("matched-style", "Matched your document’s style (1 heading, 1 entry, 2 bullets, 1 paragraph)")
    assert found["other", "google-docs"]["html"].startswith("<p><strong>Work</strong></p><p><strong>Harbor &amp; Co</strong>") and found["doc", "plain"]["text"].startswith("## Work")


def test_notes_are_json(spark):
    row = transform(spark.createDataFrame([("x", None, "a\u200bb")], SCHEMA), "rich").select(F.to_json("notes").alias("j")).first()
    assert json.loads(row["j"]) == [{"note": "hidden-chars", "count": 1, "message": "Removed 1 invisible character"}]


def test_partitions_grow_with_the_payloads(spark):
    rows = spark.range(40).selectExpr("id", "CAST(NULL AS STRING) AS html", "repeat('some words ', 20000) AS text")
    plan = transform(rows, "plain")._jdf.queryExecution().toString()
    parts = {int(n) for n in re.findall(r"hashpartitioning\(key#\d+L, (\d+)\)", plan)}
    assert partitions_of(rows, "html", "text") == 9 and parts == {9}  # 8.8 million bytes; the session's own number is 4
    assert partitions_of(rows.limit(0), "text") == 4


def test_long_runs_of_spaces_are_trimmed_past_in_one_pass(spark):
    """A pattern that looks for spaces at the end looks at each run inside again from each of its spaces."""
    from time import perf_counter

    texts = [" 　x" + " " * 200_000 + "y\n﻿", " " * 200_000, "", None]
    began = perf_counter()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.trim_space("t").alias("t")).collect()
    assert [r["t"] for r in rows] == ["x" + " " * 200_000 + "y", "", "", None] and perf_counter() - began < 20


def test_a_source_is_found_once_for_its_kind_and_label(spark, sf_dir):
    plan = clipboard.q_detect_source(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PDF text") == 1


def test_marks_of_a_line_are_parsed_once(spark):
    text = "Is **A** and `b`\n\n# \n\n- see [it](https://x.org/)"
    payloads = spark.createDataFrame([("1", None, text)], "id string, html string, text string")
    marked = runs._marked(runs.joined(scanned(sources(payloads), _scan, ("lines", "html", "markdown"), "info").repartition(2, "key")))
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Filter .*size\(CASE WHEN", plan)  # no filter below the rows of runs that parses them all once more
    found = Counter((r["kind"], r["text"], r["bold"], r["code"], r["href"]) for r in marked.collect() if r["text"])
    assert {("text", "A", True, False, None), ("text", "b", False, True, None), ("list", "it", False, False, "https://x.org/")} <= set(found) and set(found.values()) == {1}
