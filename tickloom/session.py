"""Session defaults: UTC, adaptive execution, and shuffle partitions by input size."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of shuffled input that one partition should take.
PARTITION_BYTES = 128 << 20


def session(master: str | None = None, input_bytes: int | None = None, name: str = "tickloom") -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(max(8, -(-input_bytes // PARTITION_BYTES))))
    return builder.getOrCreate()
