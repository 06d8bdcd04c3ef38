"""Helpers that the corpus operators share: durable intermediates, Arrow passes and null-safe keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Rows of a text batch that one Python step handles at a time; keeps a worker's memory flat.
SLICE = 256
#: Rows of a batch that Spark hands to Python: whole texts differ a thousandfold in length, so batches are kept short.
BATCH_ROWS = 512
#: Rows of a file of a table whose size is known, and files of a small one.
ROWS_A_FILE, FEW_FILES = 50_000, 8
#: White space of the word rules: space and U+0009 to U+000D. ``bytes.split()`` and ``bytes.strip()`` use the same set.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. No other is made up: what lies on one machine is lost to the others."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute ``df`` once into reliable storage and cut its lineage; survives the loss of executors.

    Where it is known to have at most ``rows`` rows, few of them make few files, whatever the number of partitions.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(FEW_FILES, rows // ROWS_A_FILE))).checkpoint(eager=True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut`` for wide or long tables: compressed columns in a fresh folder below the shared one."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes, a null text as no bytes; the cast copies nothing."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def crc_fold(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def arrow_pass(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in short batches; the session's batch size is lowered where it is larger."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(setting, "10000")) <= BATCH_ROWS:
        conf.set(setting, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [df[f"`{c}`"] for c in df.columns]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that what an operator adds beside it cannot clash with their names."""
    return F.struct(*columns_of(df))


def schema_with(df: DataFrame, added: str, without: str | None = None) -> StructType:
    """The schema of ``df``, but for one column, with fields added."""
    return StructType([f for f in df.schema.fields if f.name != without] + DataType.fromDDL(added).fields)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows
