"""Folders that all machines share, for what must outlive a task: stores, checkpoints of streams, tables made on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, or below the warehouse where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
