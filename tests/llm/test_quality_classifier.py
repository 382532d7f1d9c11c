from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidelog.llm import quality_classifier as qc
from tidelog.llm import queries


@pytest.mark.parametrize("k", [0, 1, 2, 57, 199, 200, 201])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=150), rng.normal(size=40) * 1e6, np.zeros(10)])
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    want = float("inf") if k == 0 else sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert qc.kth_largest(rows, "x", k, bins=8) == want


def test_model_is_a_ratio_of_counts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = qc.fit_ratio(docs, labels, buckets=64)
    raw, target = np.ones(64), np.ones(64)
    for text, good in (("a b", True), ("c c", False)):
        np.add.at(raw, qc.ngram_buckets(text, qc.Hashes(), 64), 1)
        if good:
            np.add.at(target, qc.ngram_buckets(text, qc.Hashes(), 64), 1)
    assert got == pytest.approx(np.log(target / target.sum()) - np.log(raw / raw.sum()))
    assert not qc.fit_ratio(docs, labels.limit(0), buckets=64).any()


def test_query_parts_good_from_bad(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op2_quality_classifier(spark, SF)
    assert got.count() == 200
    kept = {(r["quality"], r["kept"]): r["n"] for r in got.join(labels, "doc_id").groupBy("quality", "kept").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert kept.get((0, True), 0) <= 1 and kept.get((1, False), 0) <= 1


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "x y z", 3), (2, "x y z", 3)], "doc_id long, text string, bucket int")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = qc.keep_sampled(docs, labels)
    assert got.columns == docs.columns and got.count() == 4
    assert qc.classify(docs.limit(0), labels).count() == 0 and qc.keep_sampled(docs, labels.limit(0)).count() == 4


def test_inclusion_follows_the_weights(spark):
    """Of five rows, the one with the largest key: over many seeds each comes first as often as its weight says."""
    weights = [0.0, 0.5, 1.0, -1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(weights)), "i long, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    first = rows.withColumn("key", F.col("w") + qc.gumbel(F.col("seed"), F.col("i"))).groupBy("seed").agg(F.max_by("i", "key").alias("i")).groupBy("i").count().collect()
    want = np.exp(weights) / np.exp(weights).sum()
    assert {r["i"]: r["count"] / 4000 for r in first} == pytest.approx(dict(enumerate(want)), abs=0.03)


def test_sample_is_gumbel_top_k(spark):
    """Brute force: noise decides between like documents, and the weight between unlike ones."""
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) for _ in range(60)]
    bad = [" ".join(rng.choice(["###", "$$$"], 30)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 80, 2)], "doc_id long, quality int")
    got = qc.classify(docs, labels, share=0.5).collect()
    top = sorted(got, key=lambda r: -r["gumbel_key"])[:40]
    assert {r["doc_id"] for r in got if r["kept"]} == {r["doc_id"] for r in top} and all(r["doc_id"] < 60 for r in top)
    assert {r["doc_id"] for r in top} != {r["doc_id"] for r in sorted(got, key=lambda r: -r["log_weight"])[:40]}
    assert {r["doc_id"] for r in qc.classify(docs, labels, share=0.5, seed=3).collect() if r["kept"]} != {r["doc_id"] for r in top}
    assert {r["doc_id"] for r in qc.keep_sampled(docs, labels, share=0.5).collect()} == {r["doc_id"] for r in top}
    assert 58 <= qc.classify(docs, labels).filter("kept").count() <= 62


def test_logistic_fit():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 20, 5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(1 + 0.3 * x)))).astype(float)
    slope, offset = qc.fit_logistic(x, y)
    assert offset == pytest.approx(1, abs=0.25) and slope == pytest.approx(0.3, abs=0.04)
