"""Input tables and payload tables: ``id, html, text`` rows, one for each thing that was copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payloads that go to one partition of their scanned rows, where a task sorts these several times at once.
DEALT = 1 << 20
#: Words on a line of a hard-wrapped payload.
WRAP_WORDS = 11


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of few splits dealt out to all cores, for costly expressions; many splits are left where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def partitions_of(rows: DataFrame, *texts: str) -> int:
    """Partitions for what is scanned of the texts: as many more as these are larger, found by one pass over their lengths."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint") for t in texts), F.lit(256).cast("bigint"))
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(rows.agg(F.sum(size)).first()[0] or 0) // DEALT))


def _payload(id_: Column, html: Column | None, text: Column | None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [id_.alias("id"), (none if html is None else html).alias("html"), (none if text is None else text).alias("text")]


def document_payloads(docs: DataFrame) -> DataFrame:
    return docs.select(_payload(F.concat(F.lit("d"), F.col("doc_id").cast("string")), None, F.col("text")))


def conversation_payloads(turns: DataFrame) -> DataFrame:
    return turns.select(_payload(F.concat_ws("-", F.lit("c"), "conv_id", "turn"), None, F.col("text")))


def page_payloads(pages: DataFrame) -> DataFrame:
    return pages.select(_payload(F.concat(F.lit("p"), F.col("page_id").cast("string")), F.col("html"), None))


def all_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = document_payloads(table(spark, sf_dir, "documents"))
    return documents.unionByName(conversation_payloads(table(spark, sf_dir, "conversations"))).unionByName(page_payloads(table(spark, sf_dir, "pages")))


def dirty(text: str, key: str) -> Column:
    """A text with the flaws that copying brings: odd spaces, invisible characters, foreign line breaks, loose tabs."""
    t = F.col(text)
    kind = F.col(key) % 4
    return (
        F.when(kind == 0, F.replace(t, F.lit(", "), F.lit(",  ")))
        .when(kind == 1, F.replace(t, F.lit(". "), F.lit(".\u200b  ")))
        .when(kind == 2, F.replace(t, F.lit("\n"), F.lit("\r\n")))
        .otherwise(F.concat(F.lit("\ufeff"), F.replace(t, F.lit("e "), F.lit("e \t "))))
    )


def wrapped(text: str, words: int = WRAP_WORDS) -> Column:
    """A text broken after every so many words, as a narrow column prints it."""
    w = F.filter(F.split(F.col(text), r"[ \n]+"), lambda x: x != "")
    count = F.size(w)
    starts = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / words).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda i: F.array_join(F.slice(w, i * words + 1, words), " ")), "\n")


def tab_rows(rows: DataFrame, columns: list[str]) -> Column:
    """A row's values parted by tabs."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
