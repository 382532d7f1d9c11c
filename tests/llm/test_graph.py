from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import graph
from tidelog.plans import Scratch


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    with Scratch(spark) as work:
        got = graph.connected_components(spark.createDataFrame([*edges, *edges[:5], (7, 7)], "a long, b long"), work).collect()
        assert {r["node"]: r["component"] for r in got} == components(edges)
        assert graph.connected_components(spark.createDataFrame([], "a long, b long"), work).count() == 0


def test_possible_keeps_all_wanted(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k").withColumn("extra", F.lit("x"))
    wanted = spark.createDataFrame([(i,) for i in range(0, 5000, 50)], "k long")
    got = graph.possible(rows, F.col("k"), wanted)
    found = {r["k"] for r in got.collect()}
    assert got.columns == ["k", "extra"] and set(range(0, 5000, 50)) <= found and len(found) < 300


@pytest.mark.parametrize("rounds", [0, 2])
def test_no_link_is_lost(spark, monkeypatch, rounds):
    """Numbers in one bucket are linked if they differ by 1: leaders alone find few of these links."""
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    monkeypatch.setattr(graph, "PAIRS_A_MEMBER", 1)
    numbers = [*range(0, 30), *range(40, 50), 60, 62, 64]
    nodes = spark.createDataFrame([(n, [1, 2], n) for n in numbers] + [(1000, [3], 1000)], "node long, keys array<long>, v long")
    pairs = []

    def verify(df, work):
        rows = df.collect()
        pairs.extend(rows)
        return df.withColumn("linked", F.abs(F.col("a") - F.col("b")) == 1)

    got = graph.linked_groups(nodes, lambda x, y: F.abs(x("v") - y("v")) <= 2, verify)
    assert {r["node"]: r["component"] for r in got.collect()} == components([(a, a + 1) for a in numbers if a + 1 in numbers])
    assert all(abs(r["a"] - r["b"]) <= 2 for r in pairs)
    assert len(pairs) == len({(r["a"], r["b"]) for r in pairs})


def test_a_large_group_needs_few_pairs(spark):
    """500 nodes of one bucket, nine in ten pairs linked: pairs grow with the nodes, not with their square."""
    nodes = spark.createDataFrame([(n, [1], n) for n in range(500)], "node long, keys array<long>, v long")
    pairs = []

    def verify(df, work):
        pairs.append(df.count())
        return df.withColumn("linked", (F.xxhash64("a", "b") % 10) != 0)

    got = graph.linked_groups(nodes, lambda x, y: F.lit(True), verify)
    assert got.filter("component = 0").count() == 500 and sum(pairs) <= 500 * (2 + graph.PAIRS_A_MEMBER)
