"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows are normalised and broadcast once their size is checked to be within a bound. Beyond it a filter of their
hashes is broadcast (8 MB at most), and only document windows that pass it are shuffled to the same join. Documents' windows are looked up by their text, which is hashed and then compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import free_name, materialise, own_columns, quoted, row_key
from tidelog.llm.graph import possible

#: A word: a run of ASCII letters and digits and of anything beyond ASCII (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bytes of benchmark windows and item ids to broadcast.
MOST_BROADCAST = 32 << 20


def words(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(found: Column, width: int) -> Column:
    """Array of (pos, len, gram) of every window of ``width`` consecutive words."""
    starts = F.when(F.size(found) >= width, F.sequence(F.lit(1), F.size(found) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(width).alias("len"), F.array_join(F.slice(found, i, width), " ").alias("gram")))


def benchmark_windows(benchmark: DataFrame, *, width: int = 8, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, item): the distinct windows of each item; an item of fewer words, but not none, is one window. A null id is the id ''."""
    found = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    grams = F.when(F.size("w") < width, F.array(F.array_join("w", " "))).otherwise(F.transform(windows(F.col("w"), width), lambda x: x["gram"]))
    return found.select("item", F.size("w").alias("n"), F.explode(grams).alias("gram")).select("item", F.least("n", F.lit(width)).alias("len"), "gram").distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each distinct document row: key, doc_id, n_words, n_rows (how often it stands in the table), items (sorted distinct ids), spans (sorted, merged (start, end) word places, end exclusive).

    Rows equal in id and text are one. Tables without rows and texts without words give no hits.
    """
    grams = benchmark_windows(benchmark, width=width, item_id=item_id).groupBy("gram").agg(F.collect_set("item").alias("gram_items"), F.first("len").alias("gram_len"))
    size = F.octet_length("gram") + F.aggregate("gram_items", F.lit(0), lambda total, item: total + F.octet_length(item) + 16)
    facts = grams.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("gram_len")).alias("widths")).first()  # one row, at most ``width`` widths
    widths = facts["widths"]
    grams = grams.drop("gram_len")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = base.select("doc_id", row_key("doc_id", "text").alias("key"), words(F.col("text")).alias("w"))
    # the entry without a gram keeps every document in the result
    none = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("gram")))
    scanned = base.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(none, *(windows(F.col("w"), n) for n in widths))).alias("x"))
    scanned = scanned.select("doc_id", "key", "n_words", "x.pos", "x.len", "x.gram")
    if facts["bytes"] <= MOST_BROADCAST:
        grams = F.broadcast(grams)
    else:
        scanned = possible(scanned, F.col("gram"), grams.select("gram").unionByName(grams.sparkSession.createDataFrame([(None,)], "gram string")), facts["n"])  # the null keeps the entries without a gram
    hits = scanned.join(grams, "gram", "left").filter((F.col("pos") == 0) | F.col("gram_items").isNotNull())
    place = F.when(F.col("pos") > 0, F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end")))
    grouped = hits.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count(F.when(F.col("pos") == 0, True)).alias("n_rows"), F.array_distinct(F.flatten(F.collect_set("gram_items"))).alias("items"), F.sort_array(F.collect_set(place)).alias("places"))
    span = "struct<start:int,end:int>"
    merged = F.aggregate(
        "places",
        F.array().cast(f"array<{span}>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), F.greatest(F.get(done, F.size(done) - 1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))),
    )
    return grouped.select("key", "doc_id", "n_words", "n_rows", F.sort_array("items").alias("items"), merged.alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, least_items: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurring window), n_items, items, spans, contaminated (n_items >= ``least_items``): one row for each distinct document row, n_rows of them."""
    hits = find_hits(docs, benchmark, width=width, doc_id=doc_id, text=text)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))
    return hits.select("key", "doc_id", "n_rows", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("items") >= least_items).alias("contaminated"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns of :func:`contamination`, repeated rows given back their number."""
    whole = contamination(docs, benchmark).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))
    return whole.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, least_items: int = 2, mode: str = "both") -> DataFrame:
    """The documents without contamination, with their own columns.

    ``documents`` drops those in which windows of ``least_items`` items or more occur; ``spans`` cuts the hit words out of every
    text, with the gap before each, and keeps all rows; ``both`` drops those documents and cuts what the others hold. Rows without hits are
    returned as they are, repeated rows included.
    """
    if mode not in ("documents", "spans", "both"):
        raise ValueError("mode is 'documents', 'spans' or 'both'")
    found = contamination(docs, benchmark, width=width, least_items=least_items).filter(F.size("spans") > 0)
    found = materialise(found.select("key.k0", "key.k1", "spans", "contaminated"), "contamination")  # a few rows: whole texts are not shuffled for a second pass
    names = [free_name(c, docs) for c in ("k0", "k1", "spans", "contaminated", "pieces")]
    k0, k1, spans, contaminated, pieces = names
    key = row_key(F.col("doc_id"), F.col("text").cast("string"))
    keyed = docs.select(*own_columns(docs), key["k0"].alias(k0), key["k1"].alias(k1))
    joined = keyed.join(found.toDF(*names[:4]), [k0, k1], "left")
    if mode != "spans":
        joined = joined.filter(~F.coalesce(F.col(contaminated), F.lit(False)))
    if mode == "documents":
        return joined.select(*own_columns(docs))
    # A text is cut once, into pieces of a word with the gap before it; the pieces between one span and the next are then taken out as slices. The pieces are a
    # column of their own, used twice, so that they are not found anew for each span.
    text = F.col("text").cast("string")
    cut = F.regexp_extract_all(text, F.lit(f"{GAP}(?:{ANY_CASE_WORD}|$)"), F.lit(0))
    joined = joined.select(*own_columns(docs), spans, F.when(F.col(spans).isNotNull(), cut).alias(pieces))
    ends = F.concat(F.array(F.lit(1)), F.transform(F.col(spans), lambda s: s["end"]))
    starts = F.concat(F.transform(F.col(spans), lambda s: s["start"]), F.array(F.size(F.col(pieces)) + 1))
    bounds = F.arrays_zip(ends.alias("start"), starts.alias("end"))
    rest = F.array_join(F.flatten(F.transform(bounds, lambda b: F.slice(F.col(pieces), b["start"], b["end"] - b["start"]))), "")
    return joined.select(*(F.when(F.col(spans).isNotNull(), rest).otherwise(text).alias(c) if c == "text" else F.col(quoted(c)) for c in docs.columns))


ORACLE_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n AS n, item FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
