"""Token counts by trie-shared dynamic programming.

Pre-tokens (runs without white space, behind a word mark) go into a trie. Each node holds the best unigram
score of its prefix and the number of tokens of that segmentation, computed once when the node is made from
its ancestors' scores; a pre-token's count is read off its terminal node. The pieces that end at a node come from an
automaton of all pieces, whose state a node keeps.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import broadcast_file, map_arrow, numbered, quoted

MARK = "▁"
#: How much worse than the worst piece a character outside the vocabulary is (fixed value of unigram models).
UNKNOWN_PENALTY = 10.0


class UnigramScores:
    """Scores of a vocabulary file's pieces as unigram log-probabilities.

    The file orders pieces by rank only, so a piece's probability is taken as Zipf's, 1 / (rank + 1) normalised. A
    character that no piece covers alone is an unknown of the worst score less a penalty, and counts as one token for each UTF-8 byte.
    """

    def __init__(self, content: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        skip = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not skip(i)]
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        self.score = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY


class Pieces:
    """Automaton of all pieces (Aho-Corasick): a state stands for the longest end of what was read that begins a piece."""

    def __init__(self, score: dict[str, float]):
        self.after: dict[int, int] = {}
        self.shorter = [0]
        #: (length, score) of the pieces that end in a state, the longest first.
        self.ends: list[tuple[tuple[int, float], ...]] = [()]
        depth = [0]
        for piece, s in score.items():
            state = 0
            for c in piece:
                edge = state << 21 | ord(c)
                state = self.after.get(edge, 0)
                if not state:
                    state = self.after[edge] = len(depth)
                    depth.append(depth[edge >> 21] + 1)
                    self.shorter.append(0)
                    self.ends.append(())
            self.ends[state] = ((len(piece), s),)
        for edge, state in sorted(self.after.items(), key=lambda x: depth[x[1]]):  # shorter states are whole before longer ones
            if edge >> 21:
                self.shorter[state] = self.step(self.shorter[edge >> 21], edge & 0x1FFFFF)
                self.ends[state] += self.ends[self.shorter[state]]

    def step(self, state: int, code: int) -> int:
        """The state behind one more character."""
        after = self.after.get
        found = after(state << 21 | code)
        while found is None:
            if not state:
                return 0
            state = self.shorter[state]
            found = after(state << 21 | code)
        return found


class CountingTrie:
    """Trie of pre-tokens with forward scores. ``most`` bounds its nodes: beyond it the trie starts anew."""

    def __init__(self, scores: UnigramScores, most: int = 600_000, deepest: int = 64):
        self.scores, self.most, self.deepest = scores, most, deepest
        self.pieces = Pieces(scores.score)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.tokens, self.states = array("d", [0.0]), array("i", [0]), array("i", [0])

    def count(self, word: str) -> tuple[float, int]:
        """Best score and its number of tokens; among equal scores, the fewest. Nodes are shared down to depth ``deepest``; what lies deeper is computed on the spot."""
        if len(self.best) >= self.most:
            self.clear()
        children, all_best, all_tokens, states = self.children, self.best, self.tokens, self.states
        after, shorter, ends, unknown = self.pieces.after, self.pieces.shorter, self.pieces.ends, self.scores.unknown
        codes = list(map(ord, word))
        # down the shared nodes
        node, path, find = 0, [0], children.get
        for code in codes[: self.deepest]:
            node = find(node << 21 | code, 0)
            if not node:
                break
            path.append(node)
        known, node = len(path) - 1, path[-1]
        if known == len(codes):
            return all_best[node], all_tokens[node]
        state = states[node]
        best, tokens = [all_best[i] for i in path], [all_tokens[i] for i in path]
        for d in range(known, len(codes)):
            code = codes[d]
            found = after.get(state << 21 | code)
            while found is None and state:
                state = shorter[state]
                found = after.get(state << 21 | code)
            state = found or 0
            top, n, length = -math.inf, 0, 0
            for length, score in ends[state]:
                s = best[-length] + score
                if s > top or s == top and tokens[-length] + 1 < n:
                    top, n = s, tokens[-length] + 1
            if length != 1:  # no piece covers the character alone
                s = best[-1] + unknown
                if s > top:
                    top, n = s, tokens[-1] + len(word[d].encode())
            best.append(top)
            tokens.append(n)
            if d < self.deepest:
                edge = node << 21 | code
                node = children[edge] = len(all_best)
                all_best.append(top)
                all_tokens.append(n)
                states.append(state)
        return best[-1], tokens[-1]


class Terminals(dict):
    """Pre-token -> place of its terminal values, bounded; misses go to the trie."""

    def __init__(self, trie: CountingTrie, most: int = 300_000):
        super().__init__()
        self.trie, self.most, self.score, self.tokens = trie, most, [], []

    def __missing__(self, word: str) -> int:
        s, n = self.trie.count(MARK + word)
        at = len(self.score)
        self.score.append(s)
        self.tokens.append(n)
        if len(word) <= 64:
            self[word] = at
        return at

    def of(self, text: str) -> tuple[int, int, float]:
        """Pre-tokens, tokens and score of a text."""
        if len(self.score) >= self.most:
            self.clear()
            self.score, self.tokens = [], []
        words = text.split()
        if not words:
            return 0, 0, 0.0
        at = [self[w] for w in words]
        score, tokens = self.score, self.tokens
        return len(words), sum([tokens[i] for i in at]), math.fsum([score[i] for i in at])


_TERMINALS: dict[int, Terminals] = {}


def worker_terminals(content: bytes) -> Terminals:
    key = hash(content)
    if key not in _TERMINALS:
        _TERMINALS.clear()
        _TERMINALS[key] = Terminals(CountingTrie(UnigramScores(content)))
    return _TERMINALS[key]


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_pretokens (long), n_tokens (long) and log_score (double) to the columns ``keep`` (all but the text, if None); a null or empty text has zeros.

    Pre-tokens are what ``str.split`` gives. Columns of the three names are replaced. An empty table gives none. No shuffle; a worker keeps one bounded
    trie, which starts anew when it is full: results are the same, as scores and counts are functions of a pre-token alone.
    """
    made = ["n_pretokens", "n_tokens", "log_score"]
    keep = [c for c in ([c for c in docs.columns if c != text] if keep is None else keep) if c.lower() not in made]
    held = broadcast_file(docs.sparkSession, vocabulary)

    def make():
        terminals = worker_terminals(held.value)

        def step(batch: pa.RecordBatch):
            rows = [terminals.of(t or "") for t in batch.column(len(keep)).to_pylist()]
            made_columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(np.array([r[2] for r in rows], dtype=np.float64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made_columns], names=[*keep, *made])

        return step

    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in keep), StructField("n_pretokens", LongType()), StructField("n_tokens", LongType()), StructField("log_score", DoubleType())])
    return map_arrow(numbered(docs.select(*(F.col(quoted(c)) for c in keep), F.col(quoted(text)).cast("string").alias("own_text"))), make, schema)
