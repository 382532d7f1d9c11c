from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st

from tests.conftest import SF, duck, same_rows
from tidelog.llm import quality_rules, queries


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25))
def test_repeated_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    assert quality_rules.repeated_words(words) == len(covered)


def test_rules():
    assert quality_rules.rules_of("") == (0, 0, 0, 0, 0)
    assert quality_rules.rules_of("a é　b\n\n  \na é　b\n#*x|") == (5, 12, 3, 1, 0)


def test_query(spark):
    same_rows(queries.op6_quality_rules(spark, SF).toPandas(), duck(SF).sql(queries.oracle_sql()["op6_quality_rules"]).df())


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good", "x") for i in range(20)] + [(100 + i, "bad", "bad", "x") for i in range(20)] + [(200, good, "bad", "x"), (201, None, None, "x"), (None, good, "good", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    got = quality_rules.apply_rules(docs)
    assert got.count() == len(rows)
    kept = {(r["doc_id"], r["host"]): (r["base_failed"], r["kept"]) for r in got.collect()}
    assert kept[0, "good"] == (False, True) == kept[None, "good"] and kept[100, "bad"] == (True, False) and kept[200, "bad"] == (False, False) and kept[201, ""] == (True, False)
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0
