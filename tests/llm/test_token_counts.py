from __future__ import annotations

import math

import public_tokenizers
import pytest
from tokenizers.models import Unigram

from tests.conftest import SF
from tidelog.llm import queries, token_counts
from tidelog.llm.token_counts import MARK, CountingTrie, UnigramScores

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCORES = UnigramScores(open(PATH, "rb").read())  # noqa: SIM115


def brute(word: str) -> tuple[float, int]:
    """Best segmentation by plain dynamic programming over places, without a trie."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + SCORES.longest) + 1):
            s = SCORES.score.get(word[i:j])
            n = 1
            if s is None and j == i + 1:
                s, n = SCORES.unknown, len(word[i].encode())
            if s is not None and (c := (best[i][0] + s, -(best[i][1] + n))) > (best[j][0], -best[j][1]):
                best[j] = c[0], -c[1]
    return best[-1]


WORDS = [MARK + w for w in ("hello", "hellos", "helicopter", "a", "é", "漢字😀", "x" * 200, "the", "then", "theory", "ünïcode͸", "1234567")]


def test_trie_equals_brute_force():
    trie = CountingTrie(SCORES)
    for w in WORDS * 2:
        s, n = trie.count(w)
        assert (pytest.approx(s), n) == brute(w)
    assert len(trie.best) <= 1 + sum(min(len(w), 64) for w in WORDS)
    tiny = CountingTrie(SCORES, most=5)
    assert [tiny.count(w)[1] for w in WORDS] == [brute(w)[1] for w in WORDS] and len(tiny.best) < 80


def test_pieces_that_end_at_each_place():
    """The automaton finds all pieces that end behind each character, so that no other end is looked up; scores equal plain dynamic programming exactly."""
    pieces = token_counts.Pieces(SCORES.score)
    for w in WORDS:
        state = 0
        for d, c in enumerate(w, 1):
            state = pieces.step(state, ord(c))
            assert pieces.ends[state] == tuple((k, SCORES.score[w[d - k : d]]) for k in range(min(d, SCORES.longest), 0, -1) if w[d - k : d] in SCORES.score)
    trie = CountingTrie(SCORES, deepest=3)
    assert [trie.count(w) for w in WORDS * 2] == [brute(w) for w in WORDS * 2]


def test_equals_the_library():
    model = Unigram([("<unk>", 0.0), *SCORES.score.items()], 0, False)
    for w in WORDS:
        if all(c in SCORES.score for c in w):
            assert len(model.tokenize(w)) == CountingTrie(SCORES).count(w)[1]


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen: dict[str, tuple[float, int]] = {}
    for r in queries.op3_token_counts(spark, SF).collect():
        words = docs[r["doc_id"]].split()
        found = [seen.setdefault(w, brute(MARK + w)) for w in words]
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(n for _, n in found))
        assert r["log_score"] == pytest.approx(sum(s for s, _ in found))


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (None, "", None), (2, " \n", "k"), (3, "hello", "k"), (3, "hello", "k")], "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(docs, PATH)
    assert got.columns == ["doc_id", "n_pretokens", "n_tokens", "log_score"]
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted([0, 0, 0, *[brute(MARK + "hello")[1]] * 2])
