"""Registered queries of what lives on: stores, streams with state, live pastes; and of marks in marks. Each stands beside its SQL.

Streams read the given tables as files, in several batches, and what they leave behind in a store is the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.inline import inline_html, inline_nodes
from quillon.sources.shared import shared_path
from quillon.sources.tables import spread, table
from quillon.streaming import outcomes, pastes, profiles, shortcuts
from quillon.streaming.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Longer than the tables' time: no row of theirs comes late.
ALL_TIME = "400 days"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def replayed(rows: DataFrame, name: str, files: int = 4, at_once: int = 2, last: DataFrame | None = None) -> DataFrame:
    """``rows`` as a stream of files, some in each batch, and then those of ``last``."""
    path = shared_path(rows.sparkSession, name)
    rows.repartition(files).write.parquet(path)
    if last is not None:
        last.select(*rows.columns).coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _done(stream) -> None:
    stream.awaitTermination()


# -- marks in marks

#: Orders of marks from outside in: signs of one kind can't stand in their own, and stronger signs enclose weaker ones.
_ORDERS = (
    ("bold", "italic", "strike", "bold_", "italic_", "link"),
    ("link", "strike", "bold_", "italic_", "bold", "italic"),
    ("strike", "bold", "bold_", "link", "italic", "italic_"),
    ("bold_", "bold", "italic_", "italic", "link", "strike"),
    ("link", "bold", "italic", "bold_", "strike", "italic_"),
)
_SIGNS = {"bold": "**", "italic": "*", "strike": "~~", "bold_": "__", "italic_": "_", "link": "["}


def _nested(key: Column) -> Column:
    """Text of ``key % 7`` marks in each other around code or an escaped sign."""
    orders = F.array(*[F.array(*map(F.lit, o)) for o in _ORDERS])
    signs = F.create_map(*[F.lit(x) for pair in _SIGNS.items() for x in pair])
    kinds = F.slice(F.get(orders, (key % 5).cast("int")), F.lit(1), (key % 7).cast("int"))
    leaf = F.when(key % 2 == 0, "`x`").otherwise("\\#")

    def around(inner: Column, kind: Column) -> Column:
        close = F.when(kind == "link", F.concat(F.lit("](https://x.org/"), key.cast("string"), F.lit(")"))).otherwise(signs[kind])
        return F.concat(signs[kind], F.lit("a "), inner, F.lit(" b"), close)

    return F.aggregate(F.reverse(kinds), leaf, around)


_LISTS = "[" + ", ".join("[" + ", ".join(f"'{k}'" for k in o) + "]" for o in _ORDERS) + "]"


@query(f"""WITH k AS (SELECT p_partkey, CAST(p_partkey % 7 AS INT) AS d, ({_LISTS})[p_partkey % 5 + 1][1:CAST(p_partkey % 7 AS INT)] AS kinds FROM part),
    pieces AS (SELECT *, unnest(generate_series(1, 2 * d + 1)) AS p FROM k),
    runs AS (SELECT *, CASE WHEN p <= d THEN 'a ' WHEN p > d + 1 THEN ' b' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '#' END END AS t, kinds[1:least(p, 2 * d + 2 - p)] AS m, p = d + 1 AND p_partkey % 2 = 0 AS code FROM pieces),
    html1 AS (SELECT *, CASE WHEN code THEN '<code>' || t || '</code>' ELSE t END AS h FROM runs),
    html2 AS (SELECT *, CASE WHEN list_contains(m, 'strike') THEN '<s>' || h || '</s>' ELSE h END AS h2 FROM html1),
    html3 AS (SELECT *, CASE WHEN list_has_any(m, ['italic', 'italic_']) THEN '<em>' || h2 || '</em>' ELSE h2 END AS h3 FROM html2),
    html4 AS (SELECT *, CASE WHEN list_has_any(m, ['bold', 'bold_']) THEN '<strong>' || h3 || '</strong>' ELSE h3 END AS h4 FROM html3),
    html5 AS (SELECT *, CASE WHEN list_contains(m, 'link') THEN '<a href="https://x.org/' || p_partkey || '">' || h4 || '</a>' ELSE h4 END AS h5 FROM html4)
    SELECT p_partkey, string_agg(h5, '' ORDER BY p) AS html, CAST(any_value(d - list_contains(kinds, 'link')::INT + (p_partkey % 2 = 0)::INT) AS BIGINT) AS emphasis, any_value(list_contains(kinds, 'link')::BIGINT) AS links FROM html5 GROUP BY p_partkey""")
def q_nested_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in each other, up to all six around code: read to the innermost."""
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", _nested(F.col("p_partkey")).alias("t"))
    nodes = inline_nodes("t", F.lit(True))
    total = lambda field: F.aggregate(nodes, F.lit(0), lambda n, x: n + x[field]).cast("bigint")
    return rows.select("p_partkey", inline_html("t", F.lit(True)).alias("html"), total("emphasis").alias("emphasis"), total("links").alias("links"))


# -- the store


_LATEST = "(SELECT user_id, ts, event_id, event_type FROM events WHERE event_id % 3 <= {0} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"""WITH b AS (SELECT * FROM {_LATEST.format(0)} WHERE event_type <> 'signup'), a AS (SELECT * FROM {_LATEST.format(2)} WHERE event_type <> 'signup')
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'insert' WHEN a.user_id IS NULL THEN 'delete' ELSE 'update' END AS change, b.event_id AS before_id, a.event_id AS after_id
    FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.event_id IS DISTINCT FROM b.event_id""")
def q_store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in a store of users' last events from its first version to its third; a signup takes its user out."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    store = Store(spark, shared_path(spark, "store"), e.schema, ("user_id",), ("ts", "event_id"), buckets=16)
    for part in range(3):
        store.write(e.where(F.col("event_id") % 3 == part), gone="event_type = 'signup'")
    return store.changes(0).select("user_id", "change", F.col("before.event_id").alias("before_id"), F.col("after.event_id").alias("after_id"))


# -- state of streams

_TAUGHT = {"heading": ("view", "purchase"), "entry": ("click",), "bullet": ("purchase",), "body": ("error", "view")}


def _taught(role: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in _TAUGHT[role])
    return f"max_by(CAST(event_id AS VARCHAR), o) FILTER (WHERE event_type IN ({kinds}) AND (r IS NULL OR o >= r)) AS {role}"


@query(f"""WITH e AS (SELECT user_id AS scope, event_id, event_type, row(ts, event_id) AS o, max(CASE WHEN event_type IN ('signup', 'purchase') THEN row(ts, event_id) END) OVER (PARTITION BY user_id) AS r FROM events)
    SELECT * FROM (SELECT scope, {", ".join(map(_taught, _TAUGHT))} FROM e GROUP BY scope) WHERE coalesce(heading, entry, bullet, body) IS NOT NULL""")
def q_style_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by scope from a stream of events that teach, replace and forget them."""
    kind = F.col("event_type")
    says = [F.when(kind.isin(*_TAUGHT[r]), F.col("event_id").cast("string")).alias(r) for r in _TAUGHT]
    action = F.when(kind == "signup", "forget").when(kind == "purchase", "replace").otherwise("auto")
    events = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("scope"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), *says)
    found = profiles.profile_stream(replayed(events, "samples"), late=ALL_TIME)
    store = Store(spark, shared_path(spark, "profiles"), found.drop("gone").schema, ("scope",), buckets=16)
    _done(store.follow(found, shared_path(spark, "profiles-state"), "gone", "update"))
    return store.read().select(F.col("scope").cast("bigint").alias("scope"), *_TAUGHT)


_BESIDE = "SELECT event_id, user_id, event_type, date_trunc('day', ts) + to_milliseconds(event_id % 20 * 400) AS t FROM events"


@query(f"""WITH e AS ({_BESIDE}) SELECT event_id AS paste_id, user_id, EXISTS (SELECT 1 FROM e c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND c.t <= e.t AND c.t > e.t - INTERVAL 1 SECOND) AS suppressed
    FROM e WHERE event_type = 'view'""")
def q_suppressed_pastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pastes came right behind the plain-paste shortcut, from two streams."""
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", (F.date_trunc("day", "ts") + F.make_dt_interval(secs=(F.col("event_id") % 20 * 400 / 1000).cast("decimal(18,6)"))).alias("ts"))
    # a last row on either side, long after, lets the streams give what waits
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("").alias("event_type"), F.to_timestamp(F.lit("2199-01-01")).alias("ts"))
    pasted = replayed(e.where("event_type = 'view'"), "pastes", last=end).select(F.col("event_id").alias("paste_id"), "user_id", "ts")
    pressed = replayed(e.where("event_type = 'click'"), "shortcuts", last=end).select("user_id", "ts")
    found = shortcuts.with_suppression(pasted, pressed, late=ALL_TIME)
    store = Store(spark, shared_path(spark, "suppressed"), found.schema, ("paste_id",), buckets=16)
    _done(store.follow(found, shared_path(spark, "suppressed-state")))
    return store.read().where("paste_id >= 0").select("paste_id", "user_id", "suppressed")


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS BIGINT) AS place, event_id, event_type FROM events QUALIFY place <= 5")
def q_outcome_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest outcomes of each user, kept in a ring by a stream."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("what"))
    found = outcomes.ring_stream(replayed(rows, "outcomes"), late=ALL_TIME, keep_days=4000)
    store = Store(spark, shared_path(spark, "rings"), found.drop("gone").schema, ("key",), buckets=16)
    _done(store.follow(found, shared_path(spark, "rings-state"), "gone", "update"))
    return store.read().select(F.col("key").alias("user_id"), F.posexplode("ring").alias("k", "x")).select("user_id", (F.col("k") + 1).cast("bigint").alias("place"), F.col("x.id").alias("event_id"), F.col("x.what").alias("event_type"))


@query("SELECT user_id AS site, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts DESC, event_id DESC LIMIT 20")
def q_newest_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last outcome of each of the twenty newest sites, kept up batch by batch."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("site"), "ts", "event_id", "event_type")
    path = shared_path(spark, "newest")
    _done(outcomes.follow_newest(replayed(rows, "visits"), path, shared_path(spark, "newest-state"), "site", "ts", "event_id"))
    return outcomes.newest_keys(spark, path).select("site", "event_id", "event_type")


# -- live pastes


@query("""WITH s AS (SELECT user_id, arg_max(value > 20, (ts, event_id)) AS enabled, CASE arg_max(event_id, (ts, event_id)) % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'gmail' ELSE 'rich' END AS d FROM events WHERE event_type = 'signup' GROUP BY user_id),
    p AS (SELECT o_orderkey AS paste_id, CAST(o_custkey % 150 AS BIGINT) AS user_id, o_orderkey % 11 = 0 AS plain_key, o_orderkey % 13 = 0 AS files, o_orderkey % 2 = 0 AS dirty FROM orders),
    j AS (SELECT p.*, coalesce(s.d, 'rich') AS destination, coalesce(s.enabled, true) AS enabled FROM p LEFT JOIN s ON p.user_id = s.user_id),
    r AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN plain_key THEN 'plain-paste-shortcut' WHEN files THEN 'files' WHEN NOT dirty THEN 'nothing-to-fix' END AS reason FROM j),
    c AS (SELECT *, 'Order no. ' || paste_id || ' is here.' AS clean, 'Order ' || CASE WHEN dirty THEN '  no.  ' ELSE 'no. ' END || paste_id || ' is here.' AS raw, CASE destination WHEN 'plain' THEN 'Plain text' WHEN 'gmail' THEN 'Gmail' ELSE 'Rich text' END AS label FROM r)
    SELECT paste_id, user_id, destination, reason, CASE WHEN files THEN NULL WHEN reason IS NULL THEN clean ELSE raw END AS text, CASE WHEN reason IS NULL AND destination = 'gmail' THEN '<div>' || clean || '</div>' WHEN reason IS NULL AND destination = 'rich' THEN '<p>' || clean || '</p>' END AS html,
    CASE WHEN reason IS NULL THEN 1 ELSE 0 END::BIGINT AS fixes, CASE WHEN reason IS NULL THEN 'Pasted cleanly' WHEN reason = 'plain-paste-shortcut' THEN 'Pasted as plain text' WHEN reason <> 'disabled' THEN 'Pasted normally' END AS title,
    CASE WHEN reason IS NULL THEN 'Collapsed 2 runs of extra spaces' WHEN reason = 'plain-paste-shortcut' THEN 'That shortcut is the browser’s own plain paste, which is left alone.' WHEN reason = 'files' THEN 'Images and files pass through untouched.' WHEN reason = 'nothing-to-fix' THEN 'Already clean: nothing to fix.' END AS lines FROM c""")
def q_live_pastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pastes of orders' notes under their users' settings, from a stream of pastes and a store of settings."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "ts", "event_id", (F.col("value") > 20).alias("enabled"), F.get(F.array(F.lit("plain"), F.lit("gmail")), (F.col("event_id") % 3).cast("int")).alias("destination"))
    settings = Store(spark, shared_path(spark, "settings"), e.schema, ("user_id",), ("ts", "event_id"), buckets=16)
    settings.write(e)
    o = table(spark, sf_dir, "orders")
    key, files = F.col("o_orderkey"), F.col("o_orderkey") % 13 == 0
    said = F.concat(F.lit("Order "), F.when(key % 2 == 0, "  no.  ").otherwise("no. "), key.cast("string"), F.lit(" is here."))
    rows = o.select(key.alias("paste_id"), (F.col("o_custkey") % 150).alias("user_id"), F.lit(None).cast("string").alias("html"), F.when(~files, said).alias("text"), files.cast("int").alias("n_files"), F.when(key % 11 == 0, 500).cast("bigint").alias("ms_since_shortcut"))
    out = shared_path(spark, "cleaned")
    _done(pastes.clean_stream(replayed(rows, "pasted"), settings, out, shared_path(spark, "cleaned-state")))
    return pastes.results(spark, out).select("paste_id", "user_id", "destination", "reason", "text", "html", "fixes", "title", F.array_join("lines", "\n").alias("lines"))


@query("""WITH i AS (SELECT l_orderkey AS id, l_linenumber * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS position, CASE WHEN l_linenumber % 3 = 0 THEN '<p>' || l_returnflag || '</p>' END AS html, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS text FROM lineitem)
    SELECT id, arg_min(html, position) FILTER (WHERE html IS NOT NULL) AS html, arg_min(text, position) FILTER (WHERE text IS NOT NULL) AS text FROM i GROUP BY id""")
def q_clipboard_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of several items each: of either flavour the first that an item offers."""
    place = F.expr("row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice)")
    n = F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (n * 1000 + place).alias("position"), F.when(n % 3 == 0, F.concat(F.lit("<p>"), F.col("l_returnflag"), F.lit("</p>"))).alias("html"), F.when(n % 2 == 0, F.col("l_linestatus")).alias("text"))
    return pastes.clipboard_items(items, "id")
