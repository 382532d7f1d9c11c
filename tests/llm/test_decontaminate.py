from __future__ import annotations

import re

import pytest

from tests.conftest import SF, duck, same_rows
from tidelog.llm import decontaminate as dc
from tidelog.llm import queries

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
OTHER = "one two three four five six seven eight nine ten"
SHORT = "tiny item"


def docs_of(spark, *rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gram string")


def bench_of(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def brute(text, items, width=8):
    words = lambda t: re.findall(dc.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(width, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found)


def test_query(spark):
    same_rows(queries.op1_decontamination(spark, SF).toPandas(), duck(SF).sql(queries.oracle_sql()["op1_decontamination"]).df())


def test_brute_force(spark):
    items = [(1, ITEM), (2, OTHER), (3, SHORT), (4, ""), (5, None), (6, "--- !"), (7, "tiny")]
    rows = [(1, f"x {ITEM.upper()} y {OTHER}"), (2, "alpha beta gamma delta epsilon zeta eta"), (3, "a, tiny; ITEM b tiny"), (4, None), (5, ""), (None, ITEM), (6, f"{ITEM} {ITEM}"), (7, "É" * 3 + " tiny"), (8, "clean words " * 3000 + SHORT)]
    rows += [(6, f"{ITEM} {ITEM}")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in dc.digest(docs_of(spark, *rows), bench_of(spark, *items)).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t in rows), key=str)


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, bench = docs_of(spark, (1, ITEM), (2, "none")), bench_of(spark, (1, ITEM))
    want = sorted(map(tuple, dc.digest(docs, bench).collect()))
    monkeypatch.setattr(dc, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, dc.digest(docs, bench).collect())) == want
    same_rows(queries.op1_decontamination(spark, SF).toPandas(), duck(SF).sql(queries.oracle_sql()["op1_decontamination"]).df())


def test_removal_takes_linear_time(spark):
    """A long text with hits all over: 20,000 words, and no more than a few times what a quarter of it takes."""
    import time

    bench = bench_of(spark, (1, ITEM))
    seconds = []
    for n in (500, 500, 2000):
        text = f"some words that are its own {ITEM}; " * n
        began = time.perf_counter()
        got = dc.remove_contamination(docs_of(spark, (1, text)), bench).first()["text"]
        seconds.append(time.perf_counter() - began)
        assert got == "some words that are its own; " * n
    assert seconds[2] < 4 * seconds[1] + 10


def test_removal(spark):
    bench = bench_of(spark, (1, ITEM), (2, OTHER))
    docs = docs_of(spark, (1, f"Keep. {ITEM}! And {OTHER}."), (2, f"Before, {ITEM}; after."), (3, "clean"), (3, "clean"), (4, None))
    texts = lambda mode: sorted((r["doc_id"], r["text"]) for r in dc.remove_contamination(docs, bench, mode=mode).na.fill("").collect())
    rest = [(3, "clean"), (3, "clean"), (4, "")]
    assert texts("documents") == [(2, f"Before, {ITEM}; after."), *rest]
    assert texts("spans") == [(1, "Keep! And."), (2, "Before; after."), *rest]
    assert texts("both") == [(2, "Before; after."), *rest]
    assert dc.remove_contamination(docs, bench).columns == docs.columns
    with pytest.raises(ValueError):
        dc.remove_contamination(docs, bench, mode="other")


def test_empty_tables(spark):
    docs, bench = docs_of(spark, (1, ITEM)), bench_of(spark, (1, ITEM))
    assert dc.digest(docs.limit(0), bench).count() == 0
    assert [(r["n_hit"], r["n_items"]) for r in dc.digest(docs, bench.limit(0)).collect()] == [(0, 0)]
    assert dc.remove_contamination(docs, bench.limit(0)).count() == 1
