"""Operators on logs: DataFrame in, DataFrame out, lazy and unordered unless the name says otherwise.

A log is a DataFrame with the columns of :data:`tidelog.schema.ENTRY_SCHEMA`; file_id and ord, where present, order
versions of one key with the same sequence number.
"""

from __future__ import annotations

import logging
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import config
from tidelog import functions as fn
from tidelog.plans import free_name, running_total, with_position
from tidelog.schema import ENTRY_SCHEMA, EXPIRING, NORMAL, TOMBSTONE

ENTRY_COLUMNS = ENTRY_SCHEMA.fieldNames()


def empty(spark: SparkSession) -> DataFrame:
    """A memory table without entries."""
    return spark.createDataFrame([], ENTRY_SCHEMA)


def entries(df: DataFrame, *, key: Column, seq: Column, tag: Column | int = NORMAL, value: Column | None = None, expire_at: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """Rows of any table as log entries; a tombstone's value and the expiry of all but expiring entries are null."""
    tag = F.lit(tag) if isinstance(tag, int) else tag
    value = F.lit(None) if value is None else value
    expire_at = F.lit(None) if expire_at is None else expire_at
    return df.select(
        key.cast("binary").alias("key"),
        seq.cast("long").alias("seq"),
        tag.cast("byte").alias("tag"),
        F.when(tag != TOMBSTONE, value.cast("binary")).alias("value"),
        F.when(tag == EXPIRING, expire_at.cast("long")).alias("expire_at"),
        *(c.alias(n) for n, c in (more or {}).items()),
    )


def puts(df: DataFrame, *, key: Column, seq: Column, value: Column) -> DataFrame:
    return entries(df, key=key, seq=seq, tag=NORMAL, value=value)


def deletes(df: DataFrame, *, key: Column, seq: Column) -> DataFrame:
    """Tombstones, also for keys that were never written."""
    return entries(df, key=key, seq=seq, tag=TOMBSTONE)


def expiring_puts(df: DataFrame, *, key: Column, seq: Column, value: Column, expire_at: Column) -> DataFrame:
    return entries(df, key=key, seq=seq, tag=EXPIRING, value=value, expire_at=expire_at)


def places(log: DataFrame) -> list[str]:
    return [c for c in ("file_id", "ord") if c in log.columns]


def recover(log: DataFrame, min_seq: int = 0) -> DataFrame:
    """All versions with a sequence of ``min_seq`` or more."""
    return log.filter(F.col("seq") >= min_seq)


def recover_ordered(log: DataFrame, min_seq: int = 0) -> DataFrame:
    """:func:`recover` in the order of sequence, then file and place."""
    return recover(log, min_seq).orderBy("seq", *places(log))


def recovery_summary(log: DataFrame, min_seq: int = 0) -> DataFrame:
    """entries and max_seq of what recovery keeps; 0 and 0 if it keeps nothing, so don't resume numbering from it then."""
    return recover(log, min_seq).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("max_seq"))


def log_recovery(log: DataFrame, min_seq: int = 0) -> tuple[int, int]:
    """entries and max_seq of :func:`recovery_summary`, computed at once and written to Python's log with the time that it took."""
    began = time.monotonic()
    entries, max_seq = recovery_summary(log, min_seq).first()
    logging.getLogger(__name__).info("recovered %d entries up to sequence %d in %d ms", entries, max_seq, (time.monotonic() - began) * 1000)
    return entries, max_seq


def file_stats(log: DataFrame) -> DataFrame:
    """file_id, entries, bytes (as records on disk) of each file."""
    return log.groupBy("file_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(fn.record_len()).alias("bytes"))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    n = free_name("n", rows)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def latest(log: DataFrame, *, order: str = "seq") -> DataFrame:
    """The newest version of each key, tombstones included.

    ``seq``: the highest sequence, then file and place. ``arrival``: the last written by file and place, whatever its sequence. Spark
    keeps one row a key in each task before the shuffle, so a hot key doesn't fill a task.
    """
    if order not in ("seq", "arrival"):
        raise ValueError("order is 'seq' or 'arrival'")
    by = places(log) if order == "arrival" else ["seq", *places(log)]
    if not by:
        raise ValueError("order by arrival needs file_id or ord")
    return first_of(log, ["key"], [F.desc(c) for c in by])


def snapshot(log: DataFrame) -> DataFrame:
    """:func:`latest` in key order."""
    return latest(log).orderBy("key")


def get(log: DataFrame, key: bytes) -> DataFrame:
    """The newest version of one key, which may be a tombstone; no row for an unknown key. The key filter reaches the scan."""
    return latest(log.filter(F.col("key") == F.lit(key)))


def range_scan(log: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """Newest versions of keys from ``low`` up to, not including, ``high``, in key order. Both bounds reach the scan."""
    if low is not None:
        log = log.filter(F.col("key") >= F.lit(low))
    if high is not None:
        log = log.filter(F.col("key") < F.lit(high))
    return snapshot(log)


def as_of_seq(log: DataFrame, seq: int) -> DataFrame:
    """Newest versions as they were at a sequence number."""
    return latest(log.filter(F.col("seq") <= seq))


def merge_tiers(tiers: list[DataFrame]) -> DataFrame:
    """One row for each key from the first tier that has it (newest tier first), with the tier's number; tombstones included.

    All tiers go through one window, and so one shuffle: by tier, then the newest version within it.
    """
    numbered = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    return first_of(numbered, ["key"], [F.asc("tier"), F.desc("seq"), *(F.desc(c) for c in places(numbered))])


def compact(log: DataFrame, *, bottom: bool) -> DataFrame:
    """Newest versions only. Tombstones go only if ``bottom``: the log holds every older tier, else older values would come back."""
    newest = latest(log)
    return newest.filter(~fn.is_tombstone()) if bottom else newest


def is_live(now: int) -> Column:
    """Neither deleted nor expired at ``now`` (Unix seconds)."""
    return ~fn.is_tombstone() & ((F.col("tag") != EXPIRING) | (F.col("expire_at") > now))


def live_at(log: DataFrame, now: int) -> DataFrame:
    """Newest versions that are neither deleted nor expired at ``now``. Other operators never look at the expiry."""
    return latest(log).filter(is_live(now))


def dedup_entries(log: DataFrame) -> DataFrame:
    """One row for each key and sequence, the last by place; values don't count for equality."""
    if not places(log):
        return log.dropDuplicates(["key", "seq"])
    return first_of(log, ["key", "seq"], [F.desc(c) for c in places(log)])


def entry_order(log: DataFrame) -> DataFrame:
    """Adds position: from 1, by key, newest first within a key."""
    return with_position(log, [F.col("key").asc(), F.col("seq").desc(), *(F.col(c).desc() for c in places(log))])


def memtable_size(log: DataFrame) -> DataFrame:
    """bytes that the newest versions take in the memory table."""
    return latest(log).agg(F.coalesce(F.sum(fn.slot_size()), F.lit(0).cast("long")).alias("bytes"))


def size_trajectory(log: DataFrame, *, chunk: int = 1 << 16) -> DataFrame:
    """Adds memtable_bytes: the memory table's size behind each write, in the order of sequence.

    A new key adds its slot; a write to a known key adds the change of the value section. The write before is looked up within chunks of the sequence,
    so that a hot key is spread over tasks; one row a key and chunk goes through the window over chunks.
    """
    at, size, before, change = (free_name(c, log) for c in ("chunk", "size", "before", "change"))
    rows = log.withColumn(size, fn.serialized_len()).withColumn(at, F.floor(F.col("seq") / chunk))
    order = ["seq", *places(log)]
    last = rows.groupBy("key", at).agg(F.max_by(size, F.struct(*order)).alias(before))
    last = last.withColumn(before, F.lag(before).over(Window.partitionBy("key").orderBy(at)))
    own = Window.partitionBy("key", at).orderBy(*order)
    grown = F.col(size) - F.coalesce(F.lag(size).over(own), F.col(before))
    rows = rows.join(last.withColumnRenamed("key", "of_key").withColumnRenamed(at, "of_chunk"), F.col("key").eqNullSafe(F.col("of_key")) & (F.col(at) == F.col("of_chunk"))).drop("of_key", "of_chunk")
    rows = rows.withColumn(change, F.coalesce(grown, fn.slot_size())).drop(at, size, before)
    return running_total(rows, F.col(change), "seq", places(log), "memtable_bytes", chunk).drop(change)


def flush_points(log: DataFrame, memtable_bytes: int | None = None) -> DataFrame:
    """seq and size at the first write with which the memory table reaches ``memtable_bytes`` (None: the configuration's memtable_size_mb); no row if none does."""
    most = config.current().storage.memtable_size_mb << 20 if memtable_bytes is None else memtable_bytes
    full = size_trajectory(log).filter(F.col("memtable_bytes") >= most)
    return full.groupBy().agg(F.min(F.struct("seq", "memtable_bytes")).alias("x")).filter("x IS NOT NULL").select("x.seq", "x.memtable_bytes")


def flush(log: DataFrame, path: str, *, bloom: bool = True) -> None:
    """Write the newest versions as a Parquet table sorted by key within its files, with a Bloom filter on the key."""
    writer = latest(log).repartitionByRange("key").sortWithinPartitions("key").write
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(path)
