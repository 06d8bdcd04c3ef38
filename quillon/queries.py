"""The registered queries of the clipboard engine: each applies its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import dimensions
from quillon.functions import css, detect, feedback, links, text
from quillon.functions.inline import inline_html, inline_text
from quillon.operators import lines, linescan, markup, relational, styles, tables
from quillon.streaming.store import upsert
from quillon.plans.transform import note_counts, transform
from quillon.sources.tables import all_payloads, dirty, document_payloads, page_payloads, partitions_of, spread, table, tab_rows, wrapped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", dirty("text", "doc_id").alias("t"))


@query
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean_characters("t")
    return _dirty(spark, sf_dir).select("doc_id", text.collapse_spaces(c).alias("clean"), text.hidden_characters("t").alias("hidden"), text.space_runs(c).alias("runs"))


@query
def q_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n \n")), F.lit("\n \n")).alias("t"))
    return padded.select("doc_id", lines.blank_lines("t").alias("blank_lines"))


@query
def q_detect_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", detect.detect_source(F.lit(None).cast("string"), "text").alias("s"))
    return found.select("doc_id", "s.kind", "s.label")  # taken apart behind: each part would be found anew


@query
def q_markdown_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong, weak = detect.markdown_signs("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", strong.alias("strong"), weak.cast("bigint").alias("weak"), detect.looks_like_markdown("text").alias("markdown"))


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), wrapped("text").alias("text"), F.lit(False).alias("markdown"))


@query
def q_hard_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wrapped(spark, sf_dir).withColumn("l", F.split("text", "\n", -1)).withColumn("m", F.array_max(F.transform("l", F.length)))
    return rows.select("id", F.size("l").cast("bigint").alias("n_lines"), F.col("m").cast("bigint").alias("longest"), F.coalesce(detect.is_hard_wrapped(F.col("l"), F.col("m")), F.lit(False)).alias("wrapped"))


def _scanned(rows: DataFrame) -> DataFrame:
    """Scanned lines of rows with ``id, text, markdown``, by id."""
    keyed = spread(rows).select(F.col("id").alias("key"), "markdown", F.filter(text.lines_of("text"), lambda x: ~text.is_page_marker(x)).alias("lines"))
    return linescan.text_units(keyed).where("kind <> 'end'").repartition(partitions_of(rows, "text"), "key")


@query
def q_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.reflow(_scanned(_wrapped(spark, sf_dir)))
    return found.select(F.col("key").alias("id"), F.col("block").cast("bigint").alias("block"), F.col("para").cast("bigint").alias("para"), "text", F.col("n_lines").cast("bigint").alias("n_lines"))


@query
def q_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", links.fingerprint("text").alias("fp"))
    return found.where(F.col("fp") != "").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query
def q_escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.escape_html("html").alias("escaped"))


@query
def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.count(links.safe_url("href")).alias("n_safe"), F.min("href").alias("first_href"))


@query
def q_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.page_blocks(page_payloads(table(spark, sf_dir, "pages")))
    return found.select("id", F.col("block").cast("bigint").alias("block"), "tag", "text")


@query
def q_page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[v.alias(k) for k, v in markup.audit(F.col("html")).items()], detect.detect_source("html", F.lit(None).cast("string"))["kind"].alias("kind"))


_HOSTS = ("docs.google.com", "mail.google.com", "app.slack.com", "team.slack.com", "www.notion.so", "x.notion.site", "www.example.org", "")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inline = spark.createDataFrame([(h,) for h in _HOSTS], "host string")
    return table(spark, sf_dir, "pages").select(links.host_of("url").alias("host")).distinct().unionByName(inline)


@query
def q_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _hosts(spark, sf_dir).withColumn("kind", F.explode(F.array(F.lit("rich"), F.lit("text"), F.lit("code"))))
    to = detect.detect_destination(F.col("host"), F.col("kind"), F.col("kind") == "code", F.when(F.col("host") == "www.example.org", "slack").otherwise("nonsense"), F.lit(True))
    return kinds.select("host", "kind", to.alias("destination"), detect.site_name("host").alias("site"))


@query
def q_paste_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimensions.destinations(spark).select("destination")
    empty = F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    rows = d.withColumn("empty", F.explode(empty)).withColumn("learned", F.explode(F.array(F.lit(True), F.lit(False))))
    return rows.select("destination", "empty", "learned", detect.paste_mode(F.col("destination"), F.col("empty"), F.col("learned")).alias("mode"), detect.delivery(F.col("destination"), F.col("learned")).alias("delivery"))


@query
def q_style_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(u,) for u in ("https://docs.google.com/document/d/abcdefghijk/edit", "https://docs.google.com/document/u/0/d/abcdefghijk", "ftp://x.org", "https://")], "url string")
    return table(spark, sf_dir, "pages").select("url").unionByName(rows).select("url", links.style_scope("url").alias("scope"))


@query
def q_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    facts = {
        "active": k % 7 != 0, "ms_since_shortcut": k * 100, "editable": kind != "view", "destination": F.when(kind != "error", "rich"), "has_data": k % 5 != 0, "n_files": k % 3,
        "html": F.when(k % 11 == 0, detect.CLEANED_MARKER), "text": F.when(k % 2 == 0, "x"), "ok": kind != "signup", "changed": k % 13 != 0, "delivered": F.col("value") > 10,
    }
    return e.select("event_id", detect.skip_reason(facts).alias("reason"))


@query
def q_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stored = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max_by(F.when(F.col("value") > 20, F.col("value") > 50), F.struct("ts", "event_id")).alias("enabled"))
    paused = relational.with_defaults(stored, {"enabled": True}).where(~F.col("enabled"))
    return relational.active(e, paused, ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _copies(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'click'").select("user_id", "ts", (F.get_json_object("props", "$.k").cast("int") % 2).cast("string").alias("fingerprint"), F.concat(F.lit("site"), (F.col("event_id") % 7).cast("string")).alias("site"))


def _pastes(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("paste_id"), (F.get_json_object("props", "$.k").cast("int") % 2).cast("string").alias("fingerprint"))


@query
def q_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("hour", F.col("ts")) + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 60 as int), 0)"))
    return relational.attribute(_copies(e), _pastes(e), ["user_id"]).select("paste_id", "user_id", "origin")


@query
def q_recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.recent(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id")


@query
def q_recent_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.recent(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id", keys=["user_id"])


@query
def q_last_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), "ts", "event_id", "event_type", "value")
    return relational.last_by_key(e, "site", "ts", "event_id")


@query
def q_profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    roles = {r: F.when(F.col("event_type") == r, F.col("value")) for r in ("view", "click", "error")}
    return relational.merge_over_time(e.select("user_id", "ts", "event_id", *[v.alias(k) for k, v in roles.items()]), "user_id", ["ts", "event_id"], list(roles))


@query
def q_link_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("href"))
    return relational.link_changes(runs, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "href")


@query
def q_line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where(~text.is_blank("line"))
    role = relational.line_role(F.col("line"), F.length("line") % 5 == 0, F.length("line") % 3 == 0, F.lit(False))
    return relational.first_per_role(found.withColumn("role", role), "doc_id", "n", "line", ["heading", "entry"])


_CSS = (
    "12pt", "4px", "96.5pt", "97pt", "0", "1.5", "#AbC", "#a1b2c3", "rgb(300, 4, 5)", "rgba(1,2,3,0)", "rgba(1,2,3,.5)", "red", "Arial, 'Times New Roman', x{}", "a,b,c,d,e", "", "-3px",
)


@query
def q_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(x,) for x in _CSS], "v string")
    color = css.clean_color("v")
    return v.select("v", css.clean_font_family("v").alias("family"), css.clean_font_size("v").alias("size"), css.clean_length("v").alias("length"), css.clean_line_height("v").alias("line_height"), color.alias("color"), F.round(css.contrast_on_white(color), 6).alias("contrast"))


@query
def q_trailing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ", ").otherwise(" "), F.lit("Mar "), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " - present").otherwise(""))
    s = text.split_trailing_date(said)
    return o.select("o_orderkey", s["main"].alias("main"), s["date"].alias("date"))


@query
def q_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", text.ago(ms, F.lit(1706745600000)).alias("age"))


def _supplier_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of tab rows: a head and fifty suppliers by key."""
    s = table(spark, sf_dir, "supplier")
    s = s.select(F.floor(F.col("s_suppkey") / 50).alias("page"), "s_suppkey", tab_rows(s, ["s_suppkey", "s_name"]).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "row"))), lambda x: x["row"])
    return s.groupBy("page").agg(F.concat(F.array(F.lit("Key\tName")), rows).alias("lines"))


@query
def q_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _supplier_tables(spark, sf_dir).withColumn("cells", tables.parse_tabs(F.col("lines"))).withColumn("head", tables.has_header(F.col("cells")))
    c, h = F.col("cells"), F.col("head")
    return t.select("page", "head", tables.to_tsv(c).alias("tsv"), tables.to_pipes(c).alias("pipes"), tables.to_aligned(c, h).alias("aligned"), tables.to_html(tables.escaped(c), h).alias("html"))


@query
def q_table_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _supplier_tables(spark, sf_dir).withColumn("cells", tables.parse_tabs(F.col("lines")))
    pre = F.concat(F.lit("<pre>"), text.escape_html(tables.to_aligned(F.col("cells"), F.lit(True))), F.lit("</pre>"))
    return t.select("page", tables.to_html(tables.escaped(F.col("cells")), F.lit(True), "email").alias("email"), pre.alias("pre"))


@query
def q_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of texts that differ in fences, quotes, tables and what stands before them."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    key = F.col("o_orderkey").cast("string")
    fence = F.when(k == 0, "```\n~~~\n- code\n```\n").when(k == 1, "~~~\n```\n~~~\n").when(k == 2, "").otherwise("```\nopen\n")
    parts = F.concat(F.lit("# Order "), key, F.lit("\n\n- "), F.col("o_orderstatus"), F.lit("\n- "), F.col("o_orderpriority"), F.lit("\n  goes on\n\n> quoted\n"), fence, F.lit("a | b\n--- | ---\n1 | 2\n\nlast\tline\nand\tmore\n\nalone\there"))
    found = _scanned(o.select(F.col("o_orderkey").alias("id"), parts.alias("text"), F.lit(True).alias("markdown")))
    rank = F.dense_rank().over(Window.partitionBy("key").orderBy("block")).cast("bigint")
    return found.withColumn("at", rank).groupBy(F.col("key").alias("id"), F.col("at").alias("block")).agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n_rows"))


@query
def q_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "customer"))
    said = F.concat(F.lit("**"), F.col("c_name"), F.lit("** & `x<y` see [the site](https://x.org/"), F.col("c_custkey").cast("string"), F.lit(")"))
    return c.select("c_custkey", inline_html(said, F.lit(True)).alias("html"), inline_text(said, F.lit(True)).alias("text"))


@query
def q_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of fifty parts whose indents go up and down; the glyph is told by each item's text too."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("page"), "p_partkey")
    k = F.col("p_partkey") * 7 % 11 % 3
    item = F.concat(F.when(k == 0, "• •").when(k == 1, "  ◦ ◦").otherwise("    - ▪"), F.col("p_partkey").cast("string"))
    whole = p.groupBy("page").agg(F.array_join(F.concat(F.array(F.lit("• head")), F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x["i"])), "\n").alias("text"))
    items = lines.list_items(_scanned(whole.select(F.col("page").alias("id"), "text", F.lit(False).alias("markdown")))).where("content <> 'head'")
    found = lines.bullet_classes(items.withColumn("glyph", F.substring("content", 1, 1)), "glyph")
    return found.select(F.expr("cast(substring(content, 2) as bigint)").alias("p_partkey"), F.col("depth").cast("bigint").alias("depth"), "class")


@query
def q_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What receives a paste, of facts spread over the events."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    pick = lambda *names: F.element_at(F.array(*[F.lit(x) for x in names]), F.pmod(F.col("k"), F.lit(len(names))) + 1)
    facts = {
        "tag": pick("input", "textarea", "div", "input", "div"), "type": pick("", "password", "email"), "locked": F.col("event_id") % 4 == 0, "editable": F.col("event_id") % 3 > 0, "plaintext_only": F.col("event_id") % 5 == 0,
        "host": pick("docs.google.com", "x.org", "y.org"), "width": F.col("event_id") % 50, "height": F.lit(9), "visible_text": F.when(F.col("event_id") % 2 == 0, " \n").otherwise("words"),
    }
    found = detect.paste_target(facts)
    return e.select("event_id", found["kind"].alias("kind"), found["single_line"].alias("single_line"), found["empty"].alias("empty"))


@query
def q_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users are told of pastes that were left alone."""
    reasons = q_skip_reason(spark, sf_dir).where("reason IS NOT NULL")
    label = F.when(F.col("event_id") % 2 == 0, "Gmail")
    told = feedback.skipped(F.col("reason"), label)
    return reasons.select("event_id", told["tone"].alias("tone"), told["title"].alias("title"), told["meta"].alias("meta"), F.array_join(told["lines"], "\n").alias("lines"))


@query
def q_settings_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the newest row of each user, after two batches of events."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    first = upsert(None, e.where("event_id % 2 = 0"), ["user_id"], ["ts", "event_id"])
    return upsert(first, e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"])


@query
def q_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of customers' letters, learned from two samples each and merged."""
    c = spread(table(spark, sf_dir, "customer"))
    key = F.col("c_custkey").cast("string")
    size = F.concat((F.col("c_custkey") % 90 + 6).cast("string"), F.lit("pt"))
    first = F.concat(F.lit('<h2 style="font-family:Georgia;color:#1f3a8a">PROFILE</h2><p style="font-size:'), size, F.lit(';margin-top:4pt">'), F.col("c_comment") if "c_comment" in c.columns else F.col("c_name"), F.lit(" and more words of a plain body line.</p><ul><li style=\"font-size:9pt\">item</li></ul>"))
    second = F.concat(F.lit("<p><b>"), F.col("c_name"), F.lit("</b>, role\t<i>Mar 2021</i></p><p style='font-size:10pt;color:#333'>Customer number "), key, F.lit(" has a later body line.</p>"))
    samples = c.select(key.alias("scope"), F.posexplode(F.array(first, second)).alias("at", "html")).withColumn("at", F.col("at").cast("bigint"))
    m = styles.merged(styles.learn(samples))
    body, entry, heading = F.col("body"), F.col("entry"), F.col("heading")
    return m.select(
        F.col("scope").cast("bigint").alias("c_custkey"), heading["text"]["color"].alias("heading_color"), heading["caps"].alias("caps"), entry["datesRight"].alias("dates_right"), entry["dateItalic"].alias("date_italic"),
        body["text"]["fontSize"].alias("body_size"), body["text"]["color"].alias("body_color"), F.col("bullet")["text"]["fontSize"].alias("bullet_size"), styles.described({r: F.col(r) for r in styles.ROLES}).alias("said"),
    )


@query
def q_transform_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of all texts of documents to a plain field."""
    return transform(document_payloads(table(spark, sf_dir, "documents")), "plain").select("id", "ok", "kind", "label", "text")


@query
def q_dirty_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole way tells of texts with flaws: characters, spaces, lines and paragraphs that were mended."""
    found = transform(_dirty(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("html"), F.col("t").alias("text")), "plain")
    noted = lambda name: F.coalesce(F.get(F.filter("notes", lambda n: n["note"] == name), F.lit(0))["count"], F.lit(0)).cast("bigint").alias(name.replace("-", "_").replace("hidden_chars", "hidden"))
    return found.where("ok").select(F.col("id").alias("doc_id"), noted("hidden-chars"), noted("whitespace"), noted("reflow"), noted("blank-lines"))


@query
def q_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with marks, lists, tables and quotes made of orders, for three destinations, with their notes."""
    o = table(spark, sf_dir, "orders")
    key, status, priority = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    said = F.concat(
        F.lit("# Order "), key, F.lit("\n\n\nIs **"), status, F.lit("** and \\*not\\* `**"), priority, F.lit("**`, see [it](https://x.org/_o_/"), key, F.lit(").\n\n- first\n    - deep "), key, F.lit("\n- last\n\n> quoted\n\n| Key | Status |\n| --- | --- |\n| "), key, F.lit(" | "), status, F.lit(" |"),
    )
    found = transform(o.select(key.alias("id"), F.lit(None).cast("string").alias("html"), said.alias("text")), "rich", "gmail", "plain")
    notes = F.array_join(F.transform("notes", lambda n: F.concat(n["note"], F.lit(":"), n["count"].cast("string"))), ",")
    return found.select("id", "destination", "html", "text", notes.alias("notes"))


@query
def q_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of parts: hidden elements, styled marks, references, merged cells, images and lists that start later."""
    p = table(spark, sf_dir, "part")
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    html = F.concat(
        F.lit("<p style='display:none'>"), name, F.lit("</p><h4><b>"), name, F.lit("</b></h4><p>a &#60;&eacute;&gt; <span style='font-weight:700'>"), key, F.lit("</span><a href='https://x.org/"), key, F.lit("'>go</a><button>b</button>on</p><ol start='"), (F.col("p_partkey") % 7 + 2).cast("string"),
        F.lit("'><li>x<ul><li>y</li></ul></li><li>z</li></ol><table><tr><th colspan='2'>H</th></tr><tr><td>"), key, F.lit("</td><td>"), name, F.lit("</td></tr></table><img src='https://x.org/i.png' alt='"), key, F.lit("'><img src='https://x.org/t.gif' width='1'><div>one<br><br>two<br>three</div>"),
    )
    found = transform(p.select(key.alias("id"), html.alias("html"), F.lit(None).cast("string").alias("text")), "rich")
    return found.select("id", "html", "text")


@query
def q_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(all_payloads(spark, sf_dir), "gmail")
    return found.select("id", "destination", "ok", "reason", "kind", "label", "html", "text", "changed", F.to_json("notes").alias("notes"))


@query
def q_transform_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [d[0] for d in dimensions.DESTINATIONS]
    found = transform(all_payloads(spark, sf_dir), *names)
    return found.groupBy("destination", "kind", "ok", "changed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("text_chars"), F.sum(F.length("html")).alias("html_chars"))


@query
def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = note_counts(transform(all_payloads(spark, sf_dir), "gmail", "plain")).groupBy("note", "destination").agg(F.count(F.lit(1)).alias("payloads"), F.sum("count").alias("changes"))
    order = dimensions.notes(spark).select("note", "position", "rich_only")
    return counted.join(F.broadcast(order), "note")


@query
def q_notes_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dirty(spark, sf_dir).withColumn("c", text.clean_characters("t"))
    kinds = F.array(F.struct(F.lit("hidden").alias("note"), text.hidden_characters("t").alias("n")), F.struct(F.lit("runs").alias("note"), text.space_runs("c").alias("n")))
    long = d.select((F.col("doc_id") % 4).alias("flaw"), F.explode(kinds).alias("x")).select("flaw", "x.note", "x.n")
    return relational.matrix(long, "flaw", "note", "n", ["hidden", "runs"])


@query
def q_sources_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("lang", "text")).select("lang", detect.detect_source(F.lit(None).cast("string"), "text")["label"].alias("label"))
    return d.cube("lang", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


@query
def q_quality_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dirty(spark, sf_dir).select("doc_id", text.hidden_characters("t").alias("hidden"))
    rank = F.dense_rank().over(Window.partitionBy("quality").orderBy(F.desc("hidden")))
    return d.join(table(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id").withColumn("rank", rank.cast("bigint")).where("rank <= 3").select("doc_id", "quality", "hidden", "rank")
