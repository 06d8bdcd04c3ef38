"""Registered queries of payloads that are hard on an engine, and of rules and values as data; each stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import css, detect, links
from quillon.operators import rules
from quillon.plans.transform import transform
from quillon.sources.tables import table
from quillon.state_queries import query


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("""WITH p AS (SELECT page_id, page_id % 8 AS k FROM pages)
    SELECT page_id, k <> 4 AS ok, CASE WHEN k = 4 THEN 'error' END AS reason, CASE WHEN k = 4 THEN NULL ELSE 1 END::BIGINT AS in_html, CASE WHEN k = 4 THEN NULL ELSE 1 END::BIGINT AS in_text,
    CASE k WHEN 0 THEN 900 WHEN 4 THEN NULL ELSE 0 END::BIGINT AS quotes, CASE k WHEN 2 THEN page_id % 1000 + 1 WHEN 4 THEN NULL WHEN 1 THEN 4 WHEN 6 THEN 6 ELSE 0 END::BIGINT AS cells FROM p""")
def q_hard_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One word a payload, in quotes of 900 or too many levels, loose in a table, under giant spans, deep in elements, beside odd characters."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    key, k = F.col("page_id").cast("string"), F.col("page_id") % 8
    word = _text("q", key, "e")
    deep = F.when(k == 0, 900).otherwise(1200)
    html = (
        F.when(k == 1, _text("<table><tr><td>a<td>b</tr><b>", word, "</b><tr><td>c<td>d</table>"))
        .when(k == 2, _text("<table><tr><td colspan='", (F.col("page_id") % 1000 + 1).cast("string"), "' rowspan='10000000'>", word, "<tr></table><table><tr><td>x<tr><td>y</table>"))
        .when(k == 5, _text(F.repeat(F.lit("<div>"), 3000), "<script>z</script>", word, F.repeat(F.lit("</div>"), 3000)))
        .when(k == 6, _text("<table><tr><td rowspan='99999999999'>a<td>b<td>", word, "</tr><tr><td>c<td>d</table>"))
        .when(k == 7, _text("<p><b><i><b>", F.repeat(F.lit("<span>"), 600), word, F.repeat(F.lit("</span>"), 600), "</p>"))
    )
    said = F.when(k == 3, _text("a﷐ **", word, "** ﷐")).when(k.isin(0, 4), _text(F.repeat(F.lit("> "), deep), "**", word, "**"))
    found = transform(p.select(F.col("page_id").alias("id"), html.alias("html"), said.alias("text")), "rich")
    count = lambda c, pattern: F.regexp_count(c, pattern if isinstance(pattern, Column) else F.lit(pattern)).cast("bigint")
    own = F.concat(F.lit("q"), F.col("id").cast("string"), F.lit("e"))
    return found.select(F.col("id").alias("page_id"), "ok", "reason", count("html", own).alias("in_html"), count("text", own).alias("in_text"), count("html", "<blockquote>").alias("quotes"), count("html", "<td>|<th>").alias("cells"))


_RULE = "CASE WHEN b[{0}] THEN '<hr>' ELSE '' END"


@query(f"""WITH p AS (SELECT p_partkey, p_partkey::VARCHAR AS k, [p_partkey & 1 > 0, p_partkey & 2 > 0, p_partkey & 4 > 0, p_partkey & 8 > 0, p_partkey & 16 > 0, p_partkey & 32 > 0, p_partkey & 64 > 0, p_partkey & 128 > 0] AS b, p_partkey % 5 AS s FROM part)
    SELECT p_partkey, '<p><strong>' || k || '</strong></p>' || {_RULE.format(1)} || '<blockquote><p>a</p>' || CASE WHEN b[3] OR b[4] THEN '<hr>' ELSE '' END || '<blockquote><p>b</p></blockquote><p>c</p></blockquote>' || {_RULE.format(8)} ||
    CASE s WHEN 0 THEN '<p><a href="https://x.org/' || k || '">x</a></p><p><a href="https://x.org/' || k || '">y</a></p>' WHEN 1 THEN '<p><a href="https://x.org/' || k || '">x</a> and <a href="https://x.org/' || k || '">y</a></p>'
        WHEN 2 THEN '<p><a href="https://x.org/' || k || '">x</a><br><a href="https://x.org/' || k || '">y</a></p>' WHEN 3 THEN '<p><a href="https://x.org/' || k || '">xy</a></p>'
        ELSE '<p><a href="https://x.org/' || k || '">x</a></p><blockquote><p><a href="https://x.org/' || k || '">y</a></p></blockquote>' END AS html,
    CASE s WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END::BIGINT AS links FROM p""")
def q_rules_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules at the edges of quotes in quotes, and links that go on from block to block."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    key = F.col("p_partkey").cast("string")
    rule = lambda bit, quote: F.when(F.col("p_partkey").bitwiseAND(F.lit(1 << (bit - 1))) > 0, F.lit(f"{quote}---\n{quote}\n")).otherwise("")
    link = lambda label: _text(f"[{label}](https://x.org/", key, ")")
    k = F.col("p_partkey") % 5
    between = F.when(k == 0, "\n\n").when(k == 1, " and ").when(k == 2, "\n").when(k == 3, "").otherwise("\n\n> ")
    said = _text(
        "**", key, "**\n\n", rule(1, ""), rule(2, "> "), "> a\n>\n", rule(3, "> "), rule(4, "> "), rule(5, "> > "), "> > b\n> >\n", rule(6, "> > "), ">\n> c\n>\n", rule(7, "> "), "\n", rule(8, ""), link("x"), between, link("y")
    )
    found = transform(p.select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("html"), said.alias("text")), "rich")
    counted = F.filter("notes", lambda n: n["note"] == "links")
    return found.select(F.col("id").alias("p_partkey"), "html", F.coalesce(F.get(counted, F.lit(0))["count"], F.lit(0)).cast("bigint").alias("links"))


# -- rules as data

#: Hosts of destinations, whether the host itself and those below it count, and the destination.
_SITE_RULES = (
    ("docs.google.com", True, False, "google-docs"),
    ("mail.google.com", True, False, "gmail"),
    ("slack.com", False, True, "slack"),
    ("notion.so", True, True, "notion"),
    ("notion.site", False, True, "notion"),
)


@query("""WITH h AS (SELECT lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host FROM pages UNION ALL SELECT CASE c_custkey % 7 WHEN 0 THEN 'docs.google.com' WHEN 1 THEN 't' || c_custkey || '.slack.com' WHEN 2 THEN 'notion.so' WHEN 3 THEN 'notion.site'
        WHEN 4 THEN 'x' || c_custkey || '.notion.site' WHEN 5 THEN 'www.c' || c_custkey || '.example' ELSE 'c' || c_custkey || '.example.org' END FROM customer)
    SELECT host, count(*) AS n, CASE WHEN host = 'docs.google.com' THEN 'google-docs' WHEN host = 'mail.google.com' THEN 'gmail' WHEN host LIKE '%.slack.com' THEN 'slack' WHEN host = 'notion.so' OR host LIKE '%.notion.so' OR host LIKE '%.notion.site' THEN 'notion'
        WHEN regexp_matches(host, '^(?:.*[.])?c[0-9]+[.]example$') THEN regexp_extract(host, 'c([0-9]+)[.]example$', 1) END AS value FROM h GROUP BY host""")
def q_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of many rules for each host: those of destinations, and one for each customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 7
    own = (
        F.when(k == 0, "docs.google.com").when(k == 1, _text("t", key, ".slack.com")).when(k == 2, "notion.so").when(k == 3, "notion.site").when(k == 4, _text("x", key, ".notion.site"))
        .when(k == 5, _text("www.c", key, ".example")).otherwise(_text("c", key, ".example.org"))
    )
    hosts = table(spark, sf_dir, "pages").select(links.host_of("url").alias("host")).unionByName(c.select(own.alias("host")))
    fixed = spark.createDataFrame([(at, *r) for at, r in enumerate(_SITE_RULES)], rules.RULES)
    more = c.select((F.col("c_custkey") + 100).cast("int").alias("position"), _text("c", key, ".example").alias("suffix"), F.lit(True).alias("here"), F.lit(True).alias("below"), key.alias("value"))
    return rules.first_rule(hosts, fixed.unionByName(more)).groupBy("host", "value").agg(F.count(F.lit(1)).alias("n"))


# -- addresses by their parts


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 16 AS m FROM orders)
    SELECT 'o' || k AS id, CASE m WHEN 0 THEN k % 600 < 256 WHEN 1 THEN k * 1000003 < 4294967296 WHEN 2 THEN k * 7 % 99999 <= 65535 WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN true WHEN 7 THEN k % 3 = 0 WHEN 8 THEN true WHEN 9 THEN k % 5 < 4 WHEN 10 THEN true
        WHEN 11 THEN k % 9 < 8 WHEN 12 THEN k % 4 < 2 WHEN 13 THEN false WHEN 14 THEN k * 65 % 90000 < 65536 ELSE (k // 16) % 4 < 2 END AS safe FROM o
    UNION ALL SELECT 'p' || page_id, regexp_matches(href, '(?i)^(https?:/*[^/?#]|mailto:|tel:|www[.][^/?#])') FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)""")
def q_safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses are safe: all of the pages, and forms of hosts and ports made of orders."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    pick = lambda n, *values, of=k: F.get(F.array(*map(F.lit, values)), (of % n).cast("int"))
    forms = [
        _text("http://1.2.3.", s(k % 600)), _text("http://", s(k * 1000003), "/"), _text("https://x.org:", s(k * 7 % 99999), "/p"), _text("HTTPS:\\\\u:p@h", s(k), "@x.org?q"), _text("http://a^", s(k), ".org"), _text("//x.org/", s(k)), _text("mailto:", s(k)),
        _text("http://x", pick(3, "%41", "%zz", "%7C"), ".org"), _text("www.a", s(k), ".org"), _text("http://", pick(5, "0x7f.1", "010.0.0.1", "0xffffffff", "1.2.3", "1.2.3.4.5")), _text("tel:", s(k)),
        _text("http://[", pick(9, "::1", "1:2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "fe80::a", "::", "1:2::7:8", "a:b:c:d:e:f:1.2.3.4", "1:2:3"), "]/"), _text("http://x.org:", pick(4, "", "80", "8a", "b")), _text("http://", pick(3, "x.1", "foo.0x1", "1.2.3.08")),
        _text("http://1.2.", s(k * 65 % 90000)), _text("http:", pick(4, "x.org", "///x.org", "//", "//u@/x", of=F.floor(k / 16))),
    ]
    own = table(spark, sf_dir, "orders").select(_text("o", s(k)).alias("id"), F.get(F.array(*forms), (k % 16).cast("int")).alias("href"))
    pages = table(spark, sf_dir, "pages").select(_text("p", s(F.col("page_id"))).alias("id"), F.explode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return own.unionByName(pages).select("id", links.safe_url("href").isNotNull().alias("safe"))


# -- values of styles, modes


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS m, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 13 % 256 AS b FROM part),
    c AS (SELECT *, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') AS hex FROM p),
    l AS (SELECT *, {" + ".join(f"{w} * CASE WHEN {c} / 255 <= 0.03928 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END" for c, w in (("r", 0.2126), ("g", 0.7152), ("b", 0.0722)))} AS lum FROM c)
    SELECT k AS p_partkey, CASE WHEN m IN (0, 1) OR m = 2 AND k % 10 > 0 THEN hex END AS color, CASE WHEN m IN (0, 1) OR m = 2 AND k % 10 > 0 THEN round(1.05 / (lum + 0.05), 6) END AS contrast,
    CASE WHEN m = 3 AND k % 130 BETWEEN 5 AND 96 THEN (k % 130) || 'pt' WHEN m = 4 AND k % 130 BETWEEN 5 AND 95 THEN (k % 130) || '.5px' END AS size, CASE m WHEN 3 THEN (k % 130) || 'pt' WHEN 4 THEN (k % 130) || '.5px' WHEN 5 THEN '-' || (k % 130) || 'px' END AS length,
    CASE m WHEN 3 THEN (k % 130) || 'pt' WHEN 4 THEN (k % 130) || '.5px' WHEN 5 THEN '-' || (k % 130) || 'px' WHEN 6 THEN (k % 9) || '.25' END AS line_height, CASE WHEN m = 7 THEN 'Font' || k || ', ' || chr(39) || 'Two Words' || chr(39) END AS family FROM l""")
def q_style_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of styles made of parts: colours, sizes, lengths, line heights and families, and which are kept."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    r, g, b = k * 37 % 256, k * 91 % 256, k * 13 % 256
    pair = lambda c: F.lpad(F.hex(c), 2, "0")
    forms = [
        _text("#", pair(r), pair(g), pair(b)), _text(" rgb( ", s(r), ",", s(g), " , ", s(b), ")"), _text("RGBA(", s(r), ",", s(g), ",", s(b), ",0.", s(k % 10), ")"), _text(s(k % 130), "pt"), _text(s(k % 130), ".5PX "), _text("-", s(k % 130), "px"), _text(s(k % 9), ".25"),
        _text('"Font', s(k), "\", 'Two Words', x{}, "),
    ]
    rows = p.withColumn("v", F.get(F.array(*forms), (k % 8).cast("int")))
    color = css.clean_color("v")
    return rows.select(
        "p_partkey", color.alias("color"), F.round(css.contrast_on_white(color), 6).alias("contrast"), css.clean_font_size("v").alias("size"), css.clean_length("v").alias("length"), css.clean_line_height("v").alias("line_height"), F.when(k % 8 == 7, css.clean_font_family("v")).alias("family")
    )


@query("""WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'rich' WHEN 1 THEN 'notion' WHEN 2 THEN 'google-docs' WHEN 3 THEN 'gmail' WHEN 4 THEN 'slack' ELSE 'plain' END AS d, CASE WHEN event_type = 'view' THEN true WHEN event_type = 'click' THEN false END AS empty, value > 20 AS learned FROM events)
    SELECT event_id, CASE WHEN d IN ('plain', 'slack') THEN 'adapt' WHEN coalesce(learned, false) THEN 'match-style' WHEN empty = false THEN 'adapt' ELSE 'preserve' END AS mode,
    CASE WHEN d = 'plain' OR event_id % 4 = 0 THEN 'insert-text' WHEN d = 'google-docs' THEN 'editor-only' ELSE 'insert-rich' END AS delivery FROM e""")
def q_modes_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way the formatting goes, and how it is delivered, for the places of events."""
    e = table(spark, sf_dir, "events")
    d = F.get(F.array(*map(F.lit, ("rich", "notion", "google-docs", "gmail", "slack", "plain"))), (F.col("event_id") % 6).cast("int"))
    empty = F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "click", False)
    return e.select("event_id", detect.paste_mode(d, empty, F.col("value") > 20).alias("mode"), detect.delivery(d, F.col("event_id") % 4 != 0).alias("delivery"))
