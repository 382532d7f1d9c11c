"""Structured Streaming over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import is_live
from tidelog.sources import register


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A log folder as a stream of its files."""
    register(spark)
    return spark.readStream.format("kvwal").load(folder)


def latest_view(log: DataFrame) -> DataFrame:
    """The newest version of each key as a keyed streaming aggregate; also right on a batch. Use output mode complete or update."""
    order = F.struct(*(c for c in ("seq", "file_id", "ord") if c in log.columns))
    newest = F.max_by(F.struct("seq", "tag", "value", "expire_at"), order)
    return log.groupBy("key").agg(newest.alias("x")).select("key", "x.seq", "x.tag", "x.value", "x.expire_at")


def live_view(log: DataFrame, now: int) -> DataFrame:
    """:func:`latest_view` without what is deleted or expired at ``now``; the state keeps tombstones, so that late older versions stay hidden."""
    return latest_view(log).filter(is_live(now))
