"""Live pastes: a stream of payloads cleaned under their users' settings, batch by batch, into an idempotent sink.

Each batch works on one snapshot of the settings, a version of their store. Which one is noted before the batch is worked on,
so a batch that comes again meets the settings it met at first and writes the same rows to the same place. Before any settings
are there, pastes stay as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.dimensions import DESTINATIONS
from quillon.functions.detect import CLEANED_MARKER, skip_reason
from quillon.functions.feedback import feedback
from quillon.plans.transform import fixes, transform
from quillon.sources.tables import partitions_of

from .store import Store

RESULT = "paste_id bigint, user_id bigint, destination string, reason string, html string, text string, fixes bigint, title string, lines array<string>, settings bigint"


def clipboard_items(items: DataFrame, *keys: str) -> DataFrame:
    """Payloads from clipboard items (``keys, position, html, text``): each flavour from the first item that offers it."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c)
    return items.groupBy(*keys).agg(first("html"), first("text"))


def _settings_of(spark: SparkSession, out: str, number: int, settings: Store) -> int:
    """The version of the settings that a batch works on: the one noted, else the last one, which is noted."""
    path = f"{out}/settings/at={number}"
    try:
        return spark.read.schema("version bigint").parquet(path).first()["version"]
    except AnalysisException:  # the batch's first time
        version = settings.version()
        spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(path)
        return version


def _cleaned(batch: DataFrame, held: DataFrame, version: int) -> DataFrame:
    """The results of one batch under the settings ``held`` (``user_id, enabled, destination``, nulls for defaults)."""
    own = held.select("user_id", F.coalesce("enabled", F.lit(True)).alias("enabled"), "destination")
    rows = batch.select("paste_id", "user_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), "html", "text", "ms_since_shortcut").join(own, "user_id", "left")
    rows = rows.withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "destination": F.coalesce("destination", F.lit("rich"))})
    # what the ladder turns away before a result is known is not worked on
    known = F.lit(True)
    facts: dict[str, Column] = {
        "active": F.col("enabled"), "ms_since_shortcut": F.col("ms_since_shortcut"), "editable": known, "destination": F.col("destination"), "has_data": F.coalesce("html", "text").isNotNull() | (F.col("n_files") > 0),
        "n_files": F.col("n_files"), "html": F.col("html"), "text": F.col("text"), "ok": known, "changed": known, "delivered": known,
    }
    early = rows.withColumn("early", skip_reason(facts))
    payloads = early.where("early IS NULL").select(F.struct("paste_id", "destination").alias("id"), "html", "text")
    names = [d[0] for d in DESTINATIONS]
    done = transform(payloads, *names).where(F.col("id.destination") == F.col("destination")).select(
        F.col("id.paste_id").alias("paste_id"), F.col("ok"), F.col("changed"), F.col("html").alias("new_html"), F.col("text").alias("new_text"), "notes"
    )
    # pastes meet their results in as many partitions as these were made in, whatever the batch's size
    parts = partitions_of(batch, "html", "text")
    full = early.repartition(parts, "paste_id").join(done.repartition(parts, "paste_id"), "paste_id", "left")
    late = F.when(F.col("early").isNotNull(), F.col("early")).when(~F.coalesce("ok", F.lit(False)), "transform-failed").when(~F.col("changed"), "nothing-to-fix")
    full = full.withColumn("reason", late)
    label = F.element_at(F.create_map(*[F.lit(x) for d in DESTINATIONS for x in d[:2]]), F.col("destination"))
    told = feedback(F.col("reason"), F.lit("adapt"), label, F.coalesce("notes", F.array().cast("array<struct<note: string, count: bigint, message: string>>")))
    taken = F.col("reason").isNull()
    return full.select(
        "paste_id", "user_id", "destination", "reason", F.when(taken, F.col("new_html")).otherwise(F.col("html")).alias("html"), F.when(taken, F.col("new_text")).otherwise(F.col("text")).alias("text"),
        F.when(taken, fixes(F.col("notes"))).otherwise(0).cast("bigint").alias("fixes"), told["title"].alias("title"), told["lines"].alias("lines"), F.lit(version).cast("bigint").alias("settings"),
    )


def clean_stream(pastes: DataFrame, settings: Store, out: str, checkpoint: str) -> StreamingQuery:
    """Clean a stream of ``paste_id, user_id, html, text, n_files, ms_since_shortcut``; results lie below ``out`` (``results``).

    ``paste_id`` tells pastes apart. A paste without any flavour, of a user who switched it off, or right behind the plain-paste
    shortcut keeps its content and gets the reason.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = _settings_of(spark, out, number, settings)
        if version < 0:
            none = F.lit(None).cast("string")
            done = batch.select("paste_id", "user_id", none.alias("destination"), F.lit("settings-not-loaded").alias("reason"), "html", "text", F.lit(0).cast("bigint").alias("fixes"), none.alias("title"), F.lit(None).cast("array<string>").alias("lines"), F.lit(-1).cast("bigint").alias("settings"))
        else:
            done = _cleaned(batch, settings.read(version), version)
        done.write.mode("overwrite").parquet(f"{out}/results/batch={number}")

    return pastes.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """All results, with the ``batch`` each came in."""
    return spark.read.schema(f"{RESULT}, batch bigint").parquet(f"{out}/results")


def marked_html(html: Column) -> Column:
    """Markup as it is written to the clipboard: with the mark that it is clean already."""
    return F.concat(F.lit(CLEANED_MARKER), html)

