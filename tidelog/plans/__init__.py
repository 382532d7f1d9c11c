"""Plan building blocks that keep global orders and running totals distributed."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Spark's setting by which the shuffle files of a query go when the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. One is set only where the session has none and all runs in one process, as in tests."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tidelog-"))
    return (configured or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made by :func:`shared_path`."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries within the block go as soon as each has ended, rather than when the driver collects its garbage."""
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)


def materialise(df: DataFrame, label: str = "plan") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors, and a later pass sees the same rows."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    with clean_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Working tables of one computation, removed when the ``with`` block ends. What is still to be read afterwards is written by :func:`materialise`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_path(self.spark, path)

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = shared_path(self.spark, label)
        self.paths.append(path)
        with clean_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove a working table that is needed no more before the block ends."""
        for file in df.inputFiles()[:1]:
            for path in [p for p in self.paths if f"/{p.rsplit('/', 1)[-1]}/" in file]:
                self.paths.remove(path)
                drop_path(self.spark, path)


def free_name(base: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by quoted name."""
    return [F.col(quoted(c)) for c in df.columns]


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds each row's place (from 1) in a global order. Writes the ordered rows when it is called, so that both passes see the same ones.

    Rows are range-partitioned and sorted; only a count for each partition is summed up in one place. Ties beyond ``order`` are
    placed in the order that the range partitions give them.
    """
    at, part, before = (free_name(c, df) for c in ("at", "part", "before"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = materialise(ranged).withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    return placed.join(sums, part).withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at, part, before)


def running_total(df: DataFrame, value: Column, sequence: str, ties: list[str], name: str, chunk: int = 1 << 16) -> DataFrame:
    """Adds the running total of ``value`` in the order of a BIGINT sequence and ``ties``.

    Totals are taken within chunks of the sequence; one row a chunk goes through the window over chunks.
    """
    own, part, before = (free_name(c, df) for c in ("own", "part", "before"))
    rows = df.withColumn(own, value).withColumn(part, F.floor(F.col(sequence) / chunk))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(part).agg(F.sum(own).alias("n")).select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(part).orderBy(sequence, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(own, F.sum(own).over(inside)).join(sums, part).withColumn(name, F.col(before) + F.col(own)).drop(own, part, before)
