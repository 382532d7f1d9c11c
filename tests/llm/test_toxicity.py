from __future__ import annotations

import numpy as np

from tidelog.llm import queries, toxicity
from tidelog.llm.toxicity import Grammar

INSULTS, STEMS = {"fool": 4.0, "idiot": 6.0}, {"twit": 5.0}


def test_grammar_scores_clauses():
    g = Grammar(INSULTS, STEMS)
    one = lambda t: g.clauses(t)
    assert one("A fine day. Nothing here!") == [] and g.score("") == 0
    assert one("what a fool. so it goes. an IDIOT") == [4.0, 6.0]
    assert one("you fool")[0] == 4.0 * 1.2  # aimed
    assert one("fool, you")[0] == 4.5
    assert one("not a fool")[0] == 4.0 * 0.3 and one("not at all any fool")[0] == 4.0  # out of scope
    assert one("he said fool")[0] < 4.0 and one('"fool" she wrote')[0] < 4.0
    assert one("you said not a fool")[0] < one("he said a fool")[0] < one("you fool")[0]
    assert one("twitless")[0] == 5.0 and one("twi") == []
    assert one("kill it") == [] and one("they kill")[0] == 2.0 * 1.2  # a threat needs a target
    assert g.score("a fool. an idiot.") == 10.0


def test_composition_equals_running_one_after_another():
    rng = np.random.default_rng(4)
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.aim()]
    whole = parts[0].compose(parts[1], toxicity.ALPHABET).compose(parts[2], toxicity.ALPHABET)
    for _ in range(50):
        states, state = [0, 0, 0], 0
        for symbol in rng.integers(0, 6, 30).tolist():
            out, weight, state = whole.arcs[state][symbol]
            s, total = symbol, 0.0
            for i, m in enumerate(parts):
                s, w, states[i] = m.step(states[i], s)
                total += w
            assert (out, weight) == (s, total)


def test_logistic_fit():
    x = np.array([0.0] * 50 + [10.0] * 50)
    a, b = toxicity.fit_logistic(x, (x > 5).astype(float))
    assert 1 / (1 + np.exp(-(10 * a + b))) > 0.9 and 1 / (1 + np.exp(-b)) < 0.1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.score >= 0) & (held.score <= 1)).all() and ((held.score >= 0.7) == (held.predicted == 1)).all()
    caught, wrong = held[held.toxic == 1].predicted.mean(), held[held.toxic == 0].predicted.mean()
    assert caught >= 0.8 and wrong <= 0.03


def test_rows(spark):
    docs = spark.createDataFrame([(i, "you idiot, you fool" if i % 2 else f"fine text {i}", 1) for i in range(120)] + [(None, None, 1), (500, "", 1), (500, "", 1)], "doc_id long, text string, fold int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    rows = got.collect()
    assert len(rows) == 123 and all(r["predicted"] == (r["doc_id"] or 0) % 2 for r in rows if r["doc_id"] != 500)
    assert len({r["score"] for r in rows if r["total"] == 0}) == 1
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_threats_before_their_target():
    g = Grammar(INSULTS, STEMS)
    one = lambda t: g.clauses(t)
    assert one("I will kill you") == [2.5] and one("kill them") == [2.5] and g.score("I will kill you") == 2.5
    assert one("don't kill you") == [2.0 * 0.3 + 0.5]  # negated
    assert one('said "I will kill you"') == [2.0 * 0.6 + 0.5]  # reported
    assert one("kill and burn them") == [4.5] and one("kill the fool, you") == [4.0 + 2.0 + 0.5]
    assert one("kill it. you") == [] and one("they kill you") == [2.0 * 1.2]
