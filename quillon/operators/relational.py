"""The state around a clipboard as joins, windows and aggregations: origins, outcomes, settings, styles and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How long a copy explains a paste.
MOST_AGE_SECONDS = 30 * 60


def attribute(copies: DataFrame, pastes: DataFrame, keys: list[str]) -> DataFrame:
    """``pastes`` with ``origin``: the site of the latest copy before, if it is young enough and of the same content.

    Both have ``keys, ts, fingerprint``; copies have ``site``, pastes ``paste_id``. An as-of join by windows over their union:
    only the latest copy counts, so an older copy of the same content doesn't match. At equal times copies come first.
    Windows hold a key's events of half an hour: older copies explain nothing, so each copy stands in its own stretch of time
    and in the next, and a key with any number of events is many windows.
    """
    stretch = lambda ts: F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / MOST_AGE_SECONDS)
    held = copies.select(*keys, "ts", F.explode(F.array(stretch("ts"), stretch("ts") + 1)).alias("_stretch"), F.lit(0).alias("_order"), F.lit(None).cast("bigint").alias("paste_id"), "fingerprint", F.struct("ts", "fingerprint", "site").alias("_copy"))
    asked = pastes.select(*keys, "ts", stretch("ts").alias("_stretch"), F.lit(1).alias("_order"), "paste_id", "fingerprint", F.lit(None).cast(held.schema["_copy"].dataType).alias("_copy"))
    by = Window.partitionBy(*keys, "_stretch").orderBy("ts", "_order", F.col("_copy.fingerprint"), F.col("_copy.site"))
    rows = held.unionByName(asked).withColumn("_last", F.last("_copy", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = (F.col("_last.fingerprint") == F.col("fingerprint")) & (F.col("fingerprint") != "") & (F.col("_last.ts") >= F.col("ts") - F.expr(f"INTERVAL {MOST_AGE_SECONDS} SECONDS"))
    return rows.where(F.col("_order") == 1).select(*keys, "paste_id", "ts", "fingerprint", F.when(fits, F.col("_last.site")).alias("origin"))


def recent(rows: DataFrame, at: str, tie: str, n: int = 5, keys: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows, over all or for each key."""
    if not keys:
        return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def last_by_key(rows: DataFrame, key: str, at: str, tie: str, n: int = 20) -> DataFrame:
    """The latest row of each key, and of these the newest ``n``; one pass that combines map-side."""
    rest = [c for c in rows.columns if c not in (key, at, tie)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(at, tie, *rest), F.struct(at, tie)).alias("_r")).select(key, "_r.*")
    return best.orderBy(F.desc(at), F.desc(tie)).limit(n)


def with_defaults(stored: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return stored.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def active(visits: DataFrame, paused: DataFrame, keys: list[str]) -> DataFrame:
    """Visits of sites that nobody has paused."""
    return visits.join(paused.select(*keys).distinct(), keys, "left_anti")


def merge_over_time(rows: DataFrame, key: str, at: list[str], fields: list[str]) -> DataFrame:
    """The newest value of every field that is not null, for each key."""
    order = F.struct(*at)
    return rows.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def link_changes(runs: DataFrame, key: str, *order: str) -> DataFrame:
    """``key, n_links``: how often the link changes along the runs of a key; a break or plain text ends a link."""
    previous = F.lag("href").over(Window.partitionBy(key).orderBy(*order))
    starts = F.col("href").isNotNull() & F.coalesce(previous != F.col("href"), F.lit(True))
    return runs.withColumn("_s", starts.cast("bigint")).groupBy(key).agg(F.sum("_s").alias("n_links"))


def first_per_role(lines: DataFrame, key: str, order: str, value: str, roles: list[str]) -> DataFrame:
    """The first line of each role, and the longest body line, for each key; no window is needed."""
    picked = [F.min_by(F.col(value), F.when(F.col("role") == r, F.col(order))).alias(f"first_{r}") for r in roles]
    body = F.col("role") == "body"
    longest = F.max_by(F.col(value), F.when(body, F.struct(F.length(value), -F.col(order)))).alias("longest_body")
    return lines.groupBy(key).agg(*picked, longest, *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles], F.count_if(body).alias("n_body"))


def line_role(text: Column, all_bold: Column, bold_lead: Column, is_heading: Column) -> Column:
    """A style role by a line's facts: short bold, capital or tagged lines head, lines with a bold lead enter."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    caps = (F.upper(text) == text) & (F.lower(text) != text)
    heads = (is_heading | all_bold | caps) & (words <= 6) & (F.length(text) <= 60) & ~text.rlike(r"[.;]\z") & ~text.contains("\t")
    return F.when(heads, "heading").when(bold_lead & ~all_bold & (F.length(text) <= 220), "entry").otherwise("body")


def matrix(results: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A cross-tab of counts; the columns are named, so no pass is spent on finding them."""
    return results.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0, columns)
