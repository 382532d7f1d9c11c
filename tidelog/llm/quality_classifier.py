"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are estimated: one from documents labelled as good (the target), one from all
documents (the raw distribution). A document's log-weight is the log-ratio of its probabilities under them, brought to a common length,
and documents are sampled without replacement in proportion to their weights: the k largest sums of log-weight and Gumbel noise.
k is a given share of all documents, or else the expected number of good ones, by a logistic function of the log-weight that is fitted to labelled documents.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidelog.llm.common import fit_logistic, free_name, map_arrow, materialise, numbered, own_columns, texts_of, with_text

#: Length in n-grams to which log-weights are brought: the temperature of the sampling (with the whole sum, long texts always win; the longer, the less noise
#: decides). N-grams of ratio 0 added to each text, so that short texts have weights near 1.
LENGTH, PRIOR = 50.0, 10.0
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hashes(dict):
    """Token -> 32-bit hash, bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = zlib.crc32(token.encode())
        if len(token) <= 48:
            self[token] = h
        return h


def ngram_buckets(text: str, hashes: Hashes, buckets: int) -> np.ndarray:
    """Buckets of a text's tokens and pairs of tokens."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    a, b = h[:-1], h[1:]
    pairs = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77)) >> np.uint64(7)
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """bucket, n_raw, n_target over all documents; a task gives at most ``buckets`` rows. ``targets`` (doc_id) is broadcast: its size is bounded by the caller."""
    flagged = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(targets.withColumn("target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches):
        hashes, totals = Hashes(), np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for text, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                if text:
                    found = np.bincount(ngram_buckets(text, hashes, buckets), minlength=buckets)
                    totals[0] += found
                    if target:
                        totals[1] += found
        some = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n_raw": pa.array(totals[0][some], pa.int64()), "n_target": pa.array(totals[1][some], pa.int64())})

    return flagged.mapInArrow(count, "bucket long, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def target_sample(labels: DataFrame, most_labelled: int) -> DataFrame:
    """At most ``most_labelled`` ids labelled as good, the smallest by hash."""
    good = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).select("doc_id")


def fit_ratio(docs: DataFrame, labels: DataFrame, *, buckets: int = 8192, most_labelled: int = 20_000, smoothing: float = 1.0) -> np.ndarray:
    """log(target / raw) of every bucket; zeros where no document is labelled as good."""
    counts = np.zeros((2, buckets))
    found = bucket_counts(docs, target_sample(labels, most_labelled), buckets).toPandas()  # at most ``buckets`` rows
    counts[0, found["bucket"].to_numpy(dtype=np.int64)] = found["n_raw"]
    counts[1, found["bucket"].to_numpy(dtype=np.int64)] = found["n_target"]
    if not counts[1].sum():
        return np.zeros(buckets)
    p = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def labelled_sample(labels: DataFrame, most_labelled: int) -> DataFrame:
    """(doc_id, quality) of at most ``most_labelled`` labelled documents, the smallest by hash."""
    one = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id").limit(most_labelled)


def expected_good(scored: DataFrame, labels: DataFrame, most_labelled: int) -> Column:
    """The sum over all documents of the probability that they are good; all of them where no labelled document stands in the table."""
    known = scored.select("doc_id", "log_weight").join(F.broadcast(labelled_sample(labels, most_labelled)), "doc_id").groupBy("doc_id").agg(F.max("log_weight").alias("x"), F.max("quality").alias("y")).toPandas()  # at most ``most_labelled`` rows
    if known.empty:
        return F.count(F.lit(1)).cast("double")
    slope, offset = fit_logistic(known["x"].to_numpy(dtype=float), known["y"].to_numpy(dtype=float))
    return F.sum(1 / (1 + F.exp(-(offset + slope * F.col("log_weight")))))


def gumbel(seed: Column, *row: Column) -> Column:
    """Gumbel noise as a function of a seed and a row's content."""
    uniform = (F.shiftrightunsigned(F.xxhash64(seed, *row), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def score_documents(docs: DataFrame, ratio: np.ndarray, names: list[str], *, seed: int = 17) -> DataFrame:
    """Adds to all columns of ``docs`` (doc_id, text and any others), under the given ``names``: number of n-grams, log-ratio, log-weight, and key (log-weight plus Gumbel noise).

    The noise is a function of the row's id and text. A null or empty text has the ratio 0.
    """
    buckets = len(ratio)
    columns = docs.columns
    n, total, weight, key = names

    def make():
        hashes = Hashes()

        def step(batch: pa.RecordBatch):
            sizes, sums = [], []
            for text in texts_of(batch.column(at)):
                found = ngram_buckets(text or "", hashes, buckets)
                sizes.append(len(found))
                sums.append(float(ratio[found].sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=[*columns, n, total])

        return step

    schema = StructType([*docs.schema.fields, StructField(n, LongType()), StructField(total, DoubleType())])
    source, at = with_text(docs, columns, "text")
    scored = map_arrow(numbered(source), make, schema)
    scored = scored.withColumn(weight, LENGTH * F.col(total) / (F.col(n) + PRIOR))
    return scored.withColumn(key, F.col(weight) + gumbel(F.lit(seed), F.col("doc_id"), F.col("text").cast("string")))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The k-th largest value of a column, exactly: the interval that holds it is counted in bins and narrowed, a pass over one column each time."""
    bounds = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    lo, hi, n = bounds["lo"], bounds["hi"], bounds["n"]
    if k <= 0 or n == 0:
        return float("inf")
    if k >= n:
        return lo
    left = k  # the left-th largest within [lo, hi]
    while lo < hi:
        width = (hi - lo) / bins
        inside = rows.filter(F.col(column).between(lo, hi)).withColumn("bin", F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)))
        counted = {r["bin"]: r for r in inside.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}  # at most ``bins`` rows
        for b in sorted(counted, reverse=True):
            if left <= counted[b]["n"]:
                lo, hi = counted[b]["lo"], counted[b]["hi"]
                break
            left -= counted[b]["n"]
    return lo


SCORES = ["n_features", "log_ratio", "log_weight", "gumbel_key"]


def sampling_threshold(scored: DataFrame, labels: DataFrame, share: float | None, most_labelled: int) -> float:
    """Key of the last sampled document."""
    k = expected_good(scored, labels, most_labelled) if share is None else F.lit(share) * F.count(F.lit(1))
    return kth_largest(scored, "gumbel_key", round(scored.agg(F.coalesce(k, F.lit(0.0)).alias("k")).first()["k"]))


def classify(docs: DataFrame, labels: DataFrame, *, share: float | None = None, buckets: int = 8192, most_labelled: int = 20_000, seed: int = 17) -> DataFrame:
    """doc_id, n_features, log_ratio, log_weight, gumbel_key, kept: one row for each document row.

    ``share`` of the documents are sampled (None: as many as are expected to be good). Rows with keys equal to the last sampled one are all kept, so rows equal in id and text
    are kept or rejected together. Null and empty texts have the weight 1; without good labels every weight is 1. An empty table gives none.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ratio = fit_ratio(narrow, labels, buckets=buckets, most_labelled=most_labelled)
    scored = materialise(score_documents(narrow, ratio, SCORES, seed=seed).drop("text"), "quality-scores")
    threshold = sampling_threshold(scored, labels, share, most_labelled)
    return scored.select("doc_id", *SCORES, (F.col("gumbel_key") >= threshold).alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, *, share: float | None = None, buckets: int = 8192, most_labelled: int = 20_000, seed: int = 17) -> DataFrame:
    """The documents that :func:`classify` keeps, with their own columns. Texts are scored again when the result is read, so that they are neither shuffled nor stored."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ratio = fit_ratio(narrow, labels, buckets=buckets, most_labelled=most_labelled)
    scored = materialise(score_documents(narrow, ratio, SCORES, seed=seed).select("doc_id", "log_weight", "gumbel_key"), "quality-scores")
    threshold = sampling_threshold(scored, labels, share, most_labelled)
    names = [free_name(c, docs) for c in SCORES]
    return score_documents(docs, ratio, names, seed=seed).filter(F.col(names[3]) >= threshold).select(*own_columns(docs))
