"""Quality rules with a verdict on hosts.

Rules are computed document by document. Failures are counted by host, each host's rate is shrunk towards the
hosts' common rate by a beta prior fitted to all hosts, and hosts whose shrunk rate is too high lose all their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import map_arrow, materialise

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SALTS = 32
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    key = ids[:n]
    for k in range(1, width):
        wide = key * len(numbers) + ids[k : n + k]
        key = np.unique(wide, return_inverse=True)[1] if k + 1 < width and len(numbers) > 1 << 20 else wide
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def rules_of(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes split at exactly the six ASCII spaces
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACES):
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def document_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the five counts of every document; a null text has none, a null host is the host ''."""

    def make():
        def step(batch: pa.RecordBatch):
            rows = [rules_of(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], names=["doc_id", "host", *RULES])

        return step

    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, make, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in RULES))


def host_verdicts(failures: DataFrame, *, most_failing: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, host_rate, host_rejected from rows of (host, base_failed).

    The beta prior has the mean and the variance of the hosts' rates (moments); where these don't fit a beta distribution it
    has the strength of one document. A host is rejected if its posterior mean rate is above ``most_failing``.
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()  # one row
    mean, spread = prior["m"] or 0.0, prior["v"] or 0.0
    strength = mean * (1 - mean) / spread - 1 if 0 < spread < mean * (1 - mean) else 1.0
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > most_failing).alias("host_rejected"))


def apply_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", least_words: int = 50, most_repeat_percent: int = 50, most_failing: float = 0.5) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rate, host_rejected, kept: one row for each document row.

    base_failed: fewer than ``least_words`` words or more than ``most_repeat_percent`` of them repeated. The join with the
    hosts' verdicts is salted, so that a host with a third of all documents is spread over SALTS tasks.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    rows = materialise(document_rules(docs, doc_id=doc_id, text=text, host=host).withColumn("base_failed", failed).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")), "quality-rules")
    verdicts = host_verdicts(rows, most_failing=most_failing).select("host", "host_rate", "host_rejected", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.join(verdicts, ["host", "salt"]).drop("salt").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM p),
t AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
q AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM t) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
b AS (SELECT d.doc_id, d.host, d.r, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN q USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT host, count(*) AS n, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS k FROM f GROUP BY host),
m AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 1 END AS s FROM m),
o AS (SELECT host, (k + m * s) / (n + s) > 0.5 AS host_rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM f JOIN o USING (host)
"""
