"""Shared parts of the stateful streams."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers and expiry lives in RocksDB, which spills to disk instead of filling the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
