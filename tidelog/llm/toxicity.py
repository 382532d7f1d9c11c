"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to classes by a lexicon (insults with learned weights; threats, targets, negations and verbs of speech by lists).
Three transducers over classes are composed into one machine: negation marks insults in its scope, reported speech marks
what follows it in the clause, and targets raise what is aimed at them. A clause's score is the weight of its path; a
document's score is a logistic function of its clauses' total.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import crc32_mod, fit_logistic, map_arrow, materialise

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
NEGATED, REPORTED, AIMED = 8, 16, 32  # marks added to INSULT and THREAT

# Word lists of the grammar (fixed values): English, German, French, Spanish.
TARGETS = "you your yours yourself he him she her they them dich dir du ihr euch sie er toi tu vous il elle ils elles usted ustedes ti te él ella ellos ellas".split()
NEGATIONS = "not no never isn't aren't don't without nicht kein keine keinen nie niemals ohne pas jamais sans aucun nunca jamás sin ningún ninguna".split()
REPORTS = "said says say told claimed wrote quoted called sagte sagt meinte schrieb behauptete dit disait écrit affirme dijo dice escribió afirma".split()
THREATS = "kill hurt destroy attack beat burn shoot töten schlagen verletzen vernichten tuer frapper brûler détruire matar golpear quemar destruir".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]|[\"“”„«»]")
STEMS = (4, 5, 6, 7)
#: Totals above this count as this: one plain mention weighs 3 to 9.
MOST_TOTAL = 15.0


class Transducer:
    """A deterministic weighted transducer over classes: ``arcs[state][class]`` is (class out, weight, next state); other classes pass unchanged to ``default[state]``."""

    def __init__(self, arcs: list[dict[int, tuple[int, float, int]]], default: list[int]):
        self.arcs, self.default = arcs, default

    def step(self, state: int, symbol: int) -> tuple[int, float, int]:
        return self.arcs[state].get(symbol) or (symbol, 0.0, self.default[state])

    def compose(self, then: Transducer, alphabet: list[int]) -> Transducer:
        """The machine that feeds this one's output to ``then``; weights add up."""
        states, arcs, k = {(0, 0): 0}, [], 0
        queue = [(0, 0)]
        while k < len(queue):
            a, b = queue[k]
            k += 1
            row = {}
            for symbol in alphabet:
                mid, w1, a2 = self.step(a, symbol)
                out, w2, b2 = then.step(b, mid)
                if (a2, b2) not in states:
                    states[a2, b2] = len(states)
                    queue.append((a2, b2))
                row[symbol] = out, w1 + w2, states[a2, b2]
            arcs.append(row)
        return Transducer(arcs, [0] * len(arcs))


def negation(scope: int = 3) -> Transducer:
    """Marks insults and threats up to ``scope`` words behind a negation."""
    arcs = [{NEGATION: (NEGATION, 0.0, scope)}]
    for left in range(1, scope + 1):
        arcs.append({NEGATION: (NEGATION, 0.0, scope)} | {c: (c | NEGATED, 0.0, left - 1) for c in (INSULT, THREAT)})
    return Transducer(arcs, [0, *range(scope)])


def reported_speech() -> Transducer:
    """Marks insults and threats behind a verb of speech or a quotation mark, up to the end of the clause."""
    marked = {c | m: (c | m | REPORTED, 0.0, 1) for c in (INSULT, THREAT) for m in (0, NEGATED)}
    return Transducer([{REPORT: (REPORT, 0.0, 1)}, marked], [0, 1])


def aim(bonus: float = 0.5) -> Transducer:
    """Marks what follows a target, and adds ``bonus`` when a target follows an insult or threat."""
    kinds = [c | m for c in (INSULT, THREAT) for m in (0, NEGATED, REPORTED, NEGATED | REPORTED)]
    before = {TARGET: (TARGET, 0.0, 1)} | {k: (k, 0.0, 2) for k in kinds}
    aimed = {k: (k | AIMED, 0.0, 1) for k in kinds}
    behind = {TARGET: (TARGET, bonus, 1)} | {k: (k, 0.0, 2) for k in kinds}
    return Transducer([before, aimed, behind], [0, 1, 2])


ALPHABET = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]
#: Factor of a word's weight by its marks.
FACTORS = {m: (0.3 if m & NEGATED else 1.0) * (0.6 if m & REPORTED else 1.0) * (1.2 if m & AIMED else 1.0) for m in range(0, 64, 8)}


class Grammar:
    """The composed machine with a lexicon of insults: whole words, and stems for words that are not in it."""

    def __init__(self, insults: dict[str, float], stems: dict[str, float], threat_weight: float = 2.0):
        self.insults, self.stems = insults, stems
        self.fixed = {w: (k, 0.0) for k, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws} | {w: (THREAT, threat_weight) for w in THREATS}
        self.machine = negation().compose(reported_speech(), ALPHABET).compose(aim(), ALPHABET)
        self.known: dict[str, tuple[int, float]] = {}

    def look_up(self, word: str) -> tuple[int, float]:
        """Class and weight of a lower-case word."""
        hit = self.known.get(word)
        if hit is None:
            if word in self.insults:
                hit = INSULT, self.insults[word]
            elif word in self.fixed:
                hit = self.fixed[word]
            else:
                hit = OTHER, 0.0
                for k in reversed(STEMS):
                    if len(word) >= k and word[:k] in self.stems:
                        hit = INSULT, self.stems[word[:k]]
                        break
            if len(self.known) >= 400_000:
                self.known.clear()
            self.known[word] = hit
        return hit

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses with an insult, or with a threat at somebody, in order."""
        out, state, score, matched, aimed, pending = [], 0, 0.0, False, False, 0.0
        arcs = self.machine.arcs
        for token in [*TOKEN.findall(text.lower()), "\n"]:
            if token in ".!?;\n":
                if matched or aimed:
                    out.append(score)
                state, score, matched, aimed, pending = 0, 0.0, False, False, 0.0
                continue
            symbol, weight = (REPORT, 0.0) if len(token) == 1 and token in '"“”„«»' else self.look_up(token)
            kind, extra, state = arcs[state][symbol]
            if symbol == INSULT or symbol == THREAT and kind & AIMED:
                matched = matched or symbol == INSULT
                aimed = aimed or symbol == THREAT
                score += weight * FACTORS[kind & ~7] + extra
            elif symbol == THREAT:  # counts once a target follows
                pending += weight * FACTORS[kind & ~7]
            else:
                if symbol == TARGET and pending:
                    score, aimed, pending = score + pending, True, 0.0
                if matched or aimed:
                    score += extra
        return out

    def score(self, text: str) -> float:
        """Total of the clauses, 0 if none matches. Most texts have no trigger and are not parsed."""
        known, look_up = self.known.get, self.look_up
        for w in WORD.findall(text.lower()):
            hit = known(w) or look_up(w)
            if hit[1]:
                return math.fsum(self.clauses(text))
        return 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """Texts of at most ``most_labelled`` labelled documents of the learning part (the smallest by hash), with label and fold."""
    rows = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(crc32_mod(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)  # at most so many rows of 12 bytes are broadcast
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return materialise(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).cast("int")), "toxicity-sample")


def count_words(sample: DataFrame) -> DataFrame:
    """word, toxic, clean: documents of each label with the word."""

    def make():
        def step(batch: pa.RecordBatch):
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[bool(toxic)].update(set(WORD.findall(text.lower())))
            words = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({"word": words, "toxic": pa.array([counts[1][w] for w in words], pa.int64()), "clean": pa.array([counts[0][w] for w in words], pa.int64())})

        return step

    return map_arrow(sample.select("text", "toxic"), make, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, *, most_terms: int = 4000, least_g2: float = 18.0, least_log_odds: float = 3.0) -> tuple[dict[str, float], dict[str, float]]:
    """Insults and stems with their log-odds: terms whose association with the label is significant (G squared) and strong.

    A stem must hold for three words of toxic documents, none with more than 60 % of its occurrences. The strongest ``most_terms`` terms are kept.
    """
    totals = sample.agg(F.sum(F.col("toxic").cast("double")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"] or 0.0, totals["n"] - (totals["t"] or 0.0)
    if not toxic or not clean:
        return {}, {}
    words = materialise(count_words(sample), "toxicity-words")
    prefixes = words.withColumn("k", F.explode(F.array(*map(F.lit, STEMS)))).filter(F.length("word") > F.col("k"))
    prefixes = prefixes.groupBy(F.substring("word", F.lit(1), F.col("k")).alias("word")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("toxic").alias("top"), F.count(F.when(F.col("toxic") > 0, True)).alias("kinds"))
    prefixes = prefixes.filter((F.col("kinds") >= 3) & (F.col("top") <= 0.6 * F.col("toxic"))).drop("top", "kinds")
    both = words.withColumn("stem", F.lit(False)).unionByName(prefixes.withColumn("stem", F.lit(True)))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = toxic / (toxic + clean)
    part = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
    scored = both.withColumn("g2", 2 * (part(a, share) + part(b, 1 - share))).withColumn("w", F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1)))
    kept = scored.filter((F.col("g2") >= least_g2) & (F.col("w") >= least_log_odds)).orderBy(F.desc("g2"), "word", "stem").limit(most_terms).select("word", "stem", "w").collect()
    return {r["word"]: r["w"] for r in kept if not r["stem"]}, {r["word"]: r["w"] for r in kept if r["stem"]}


def grammar_scores(docs: DataFrame, insults: dict[str, float], stems: dict[str, float], more: list[str]) -> DataFrame:
    """doc_id, the columns ``more`` and the grammar's total of every document."""

    def make():
        grammar = Grammar(insults, stems)

        def step(batch: pa.RecordBatch):
            total = [grammar.score(t) if t else 0.0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in more), pa.array(total, pa.float64())], names=["doc_id", *more, "total"])

        return step

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ["doc_id", *more]}
    return map_arrow(docs.select("doc_id", *more, F.col("text").cast("string").alias("text")), make, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", total double")


def score_toxicity(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, total (the grammar's), score (0 to 1), predicted: one row for each document row.

    Learns from at most ``most_labelled`` labelled rows whose crc32(doc_id as text) mod 3 is not 1: the lexicon from three quarters of them, the
    logistic function from the rest. Null, empty and unmatched texts get the score of a total of 0; without labels of both kinds all scores are 0.
    """
    sample = labelled_sample(docs, labels, most_labelled)
    insults, stems = learn_lexicon(sample.filter("fold > 0"))
    fit = grammar_scores(sample.filter("fold = 0"), insults, stems, ["toxic"]).select("total", "toxic").toPandas()  # at most ``most_labelled`` pairs
    scored = grammar_scores(docs, insults, stems, []).withColumn("held_out", crc32_mod(F.col("doc_id"), 3) == 1)
    if fit["toxic"].nunique() < 2 or not (insults or stems):
        scored = scored.withColumn("score", F.lit(0.0))
    else:
        a, b = fit_logistic(np.clip(fit["total"].to_numpy(), 0.0, MOST_TOTAL), fit["toxic"].to_numpy().astype(float))
        scored = scored.withColumn("score", 1 / (1 + F.exp(-(a * F.least(F.greatest("total", F.lit(0.0)), F.lit(MOST_TOTAL)) + b))))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
