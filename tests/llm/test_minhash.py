from __future__ import annotations

import random

import numpy as np

from tests.conftest import SF, duck, same_rows
from tests.llm.test_graph import components
from tidelog.llm import minhash as mh
from tidelog.llm import queries


def test_query(spark):
    same_rows(queries.op8_minhash(spark, SF).toPandas(), duck(SF).sql(queries.oracle_sql()["op8_minhash"]).df())


def test_estimate_and_bands(spark):
    rng, minima = np.random.default_rng(2), mh.Minima()
    errors = []
    for share in (0.3, 0.6, 0.8, 0.95):
        n = int(1000 * 2 * share / (1 + share))
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])) for _ in range(2))
        low = np.array([minima.of(a), minima.of(b)])
        packed = [[int(x) for x in row] for row in minima.packed(low)]
        row = {f"{side}_s{i}": packed[k][i] for k, side in enumerate("xy") for i in range(3)}
        df = spark.createDataFrame([row])
        errors.append(abs(df.select(mh.estimate(lambda c: df[f"x_{c}"], lambda c: df[f"y_{c}"])).first()[0] - share))
        if share >= 0.8:
            assert (minima.bands(low)[0] == minima.bands(low)[1]).any()
    assert max(errors) < 0.2


def variants(rng, n_docs):
    """Documents of near copies of a few bases, in chains and stars, with some of less than the threshold."""
    docs = []
    for b in range(4):
        words = [f"b{b}w{i}" for i in range(120)]
        for _ in range(n_docs // 4):
            if rng.random() < 0.5:
                words = list(words)  # a chain: changes pile up
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            docs.append(" ".join(own))
            if rng.random() < 0.4:
                words = own
    return docs


def test_brute_force(spark):
    rng = random.Random(8)
    texts = variants(rng, 80)
    texts += [texts[0], texts[0].upper(), "", None, "one two", "One\x0btwo", "one two three", "İx a b c d"]
    rows = [(i * 3, t, 0) for i, t in enumerate(texts)]
    words = mh.WordHashes()
    for width in (4, 5):
        sets = {i: set(mh.shingle_set(t, words, width).tolist()) for i, t, _ in rows}
        edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = {i: i for i in sets} | components(edges)
        docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
        got = {r["doc_id"]: r for r in mh.near_duplicates(docs, width=width).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
        assert len(set(want.values())) < len(want)


def test_shingles():
    words = mh.WordHashes()
    assert len(mh.shingle_set("a b c d e", words, 4)) == 2 and len(mh.shingle_set("a b", words, 4)) == 1 and not len(mh.shingle_set(" \n", words, 4))
    assert mh.shingle_set("A b", words, 4).tolist() == mh.shingle_set("a\tB", words, 4).tolist() != mh.shingle_set("b a", words, 4).tolist()


def test_drop(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "a"), (2, text, "b"), (2, text, "b"), (3, "own words only in here", "c"), (3, "own words only in here", "c"), (4, None, "d"), (5, "", "e"), (None, text, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_key string")
    got = mh.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"]) for r in got.collect()), key=str) == [1, 3, 4, 5, None]
    assert mh.drop_near_duplicates(docs.limit(0)).count() == 0


def test_drop_where_ids_repeat(spark):
    """Rows that share an id but not their text go only if their own text is linked."""
    a, b, own = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, a), (2, a), (2, own), (3, b), (3, own + " tail"), (4, b), (5, "x y z u v w"), (5, "other words of the same id")]
    got = mh.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted([(1, a), (2, own), (3, b), (5, "x y z u v w"), (5, "other words of the same id")])
