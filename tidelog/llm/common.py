"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans import Scratch, clean_shuffles, drop_path, free_name, materialise, own_columns, quoted, shared_path

__all__ = ["Scratch", "clean_shuffles", "drop_path", "free_name", "materialise", "own_columns", "quoted", "shared_path"]

#: White_Space of Unicode, as a regular expression class body.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def row_key(*cols: str | Column) -> Column:
    """A 128-bit key of a row's content as a struct; equal rows have equal keys, nulls included."""
    return F.struct(F.xxhash64(*cols).alias("k0"), F.xxhash64(F.lit(0x51ED), *cols).alias("k1"))


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def broadcast_file(spark: SparkSession, path: str) -> object:
    """Broadcast a vocabulary file (a few MB, fixed by the caller) so that executors need no path to it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def with_text(df: DataFrame, columns: list[str], text: str) -> tuple[DataFrame, int]:
    """The named columns with the text as a string among them, and its place: the column itself where it is one, else one more at the end."""
    kept = df.select(*(F.col(quoted(c)) for c in columns))
    if text in columns and df.schema[text].dataType.simpleString() == "string":
        return kept, columns.index(text)
    return df.select(*(F.col(quoted(c)) for c in columns), F.col(quoted(text)).cast("string").alias("own_text")), len(columns)


def texts_of(column, most: int = 512):
    """The values of an Arrow column, so many of them as Python strings at a time."""
    for at in range(0, len(column), most):
        yield from column.slice(at, most).to_pylist()


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns named by their places, as ``mapInArrow`` can't take every name; its schema gives them their names back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def map_arrow(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over ``df``; ``make`` is called once a task and returns a function of one record batch."""

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and intercept by Newton steps, halved until the loss falls; the slope's penalty keeps it finite where the labels part cleanly."""
    design, n = np.column_stack([x, np.ones_like(x)]), len(y)
    penalty = np.array([ridge * n, 1e-9])

    def loss(c: np.ndarray) -> float:
        z = design @ c
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (penalty * c * c).sum() / 2)

    c = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ c, -500, 500)))
        gradient = design.T @ (p - y) + penalty * c
        move = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9), gradient)
        size, before = 1.0, loss(c)
        while size > 1e-6 and loss(c - size * move) > before:
            size /= 2
        c = c - size * move
        if abs(size * move).max() < 1e-8:
            break
    return float(c[0]), float(c[1])
