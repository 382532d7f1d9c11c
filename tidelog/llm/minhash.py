"""Near duplicates by b-bit MinHash.

Documents with equal shingle sets are one node. Of each of 96 minima two bits are kept and packed into three longs; nodes that
share all four minima of one of 24 bands are candidates, the similarity of a candidate pair is estimated from the
packed bits, corrected for chance agreement, and pairs not ruled out by it are confirmed on their full sets.
Where many documents share a band but not all are linked, 2048 further minima with one bit each sharpen the estimate.
At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**4)**24, about 3 in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, free_name, map_arrow, materialise, own_columns, row_key
from tidelog.llm.graph import linked_groups, possible

BANDS, ROWS, BITS = 24, 4, 2
HASHES = BANDS * ROWS
LANES = 0x5555555555555555
#: Longs of the longer signature, 64 one-bit minima each.
LONGS = 32
#: Standard errors of the estimate by which a pair must fall short to be ruled out.
ERRORS = 5.0


class WordHashes(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: WordHashes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words; a text of fewer words, but not none, is one shingle."""
    found = text.encode().lower().split() if text else []  # bytes: only A-Z is lowered, and only the six ASCII spaces split
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(width, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(total)


class Minima:
    """The minima of ``n`` hash functions over a set of 64-bit hashes."""

    def __init__(self, n: int = HASHES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.n, self.block = n, max(16, 49_152 // n)
        self.a = (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        self.salt = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.n, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), self.block):
            np.minimum(low, (x[at : at + self.block, None] * self.a + self.b).min(axis=0), out=low)
        return low

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """Keys of the bands of many rows of minima."""
        key = np.broadcast_to(self.salt, (len(minima), BANDS)).copy()
        for i in range(ROWS):
            key = mix(key + minima.reshape(-1, BANDS, ROWS)[:, :, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return key.astype(np.int64)

    @staticmethod
    def packed(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
        """The low bits of each (mixed) minimum, packed into longs."""
        low = mix(minima.astype(np.uint64)) & np.uint64((1 << bits) - 1)
        each = 64 // bits
        lanes = low.reshape(len(minima), -1, each) << (np.arange(each, dtype=np.uint64) * np.uint64(bits))
        return np.bitwise_or.reduce(lanes, axis=2).astype(np.int64)


def set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits of each set as two arrays of longs; null where a set is empty."""
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return [pa.array([d and int.from_bytes(d[at : at + 8], "little", signed=True) for d in digests], pa.int64()) for at in (0, 8)]


def signatures(docs: DataFrame, width: int, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, k0, k1 (128 bits of the set, null if empty), s0..s2 (packed bits), b0..b23 (bands' keys), and the long columns ``more``."""
    names = ["s0", "s1", "s2", *(f"b{i}" for i in range(BANDS))]

    def make():
        words, minima = WordHashes(), Minima()

        def step(batch: pa.RecordBatch):
            sets = [shingle_set(t, words, width) for t in batch.column("text").to_pylist()]
            low = np.array([minima.of(s) for s in sets])
            facts = np.concatenate([minima.packed(low), minima.bands(low)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *set_keys(sets), *(pa.array(np.ascontiguousarray(facts[:, i])) for i in range(len(names))), *(batch.column(c) for c in more)], names=["doc_id", "n_shingles", "k0", "k1", *names, *more])

        return step

    return map_arrow(docs.select("doc_id", "text", *more), make, ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "k0", "k1", *names, *more)))


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """k0, k1 and the hashes of the full set of each row."""

    def make():
        words = WordHashes()

        def step(batch: pa.RecordBatch):
            sets = [s for t in batch.column("text").to_pylist() if len(s := shingle_set(t, words, width))]
            yield pa.RecordBatch.from_arrays([*set_keys(sets), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k0", "k1", "hashes"])

        return step

    return map_arrow(docs.select("text"), make, "k0 long, k1 long, hashes array<long>")


def long_signatures(docs: DataFrame, width: int) -> DataFrame:
    """k0, k1 and r0 .. r31: 2048 one-bit minima of each row's set."""

    def make():
        words, minima = WordHashes(), Minima(64 * LONGS, seed=12)

        def step(batch: pa.RecordBatch):
            sets = [s for t in batch.column("text").to_pylist() if len(s := shingle_set(t, words, width))]
            packed = Minima.packed(np.array([minima.of(s) for s in sets]).reshape(len(sets), 64 * LONGS), bits=1)
            yield pa.RecordBatch.from_arrays([*set_keys(sets), *(pa.array(packed[:, i]) for i in range(LONGS))], names=["k0", "k1", *(f"r{i}" for i in range(LONGS))])

        return step

    return map_arrow(docs.select("text"), make, "k0 long, k1 long, " + ", ".join(f"r{i} long" for i in range(LONGS)))


def least_estimate(share: float, hashes: int, bits: int) -> float:
    """The estimate that a pair of similarity ``share`` falls short of by ERRORS standard errors."""
    chance = 1 / (1 << bits)
    same = share + (1 - share) * chance
    return share - ERRORS * (same * (1 - same) / hashes) ** 0.5 / (1 - chance)


def long_estimate(left, right) -> Column:
    """Similarity from the longer signatures."""
    unequal = reduce(lambda a, b: a + b, (F.bit_count(left(f"r{i}").bitwiseXOR(right(f"r{i}"))) for i in range(LONGS)))
    return ((1 - unequal / (64 * LONGS)) - 0.5) / 0.5


def estimate(left, right) -> Column:
    """Similarity from packed bits: the share of equal pairs of bits, corrected for those equal by chance (1 in 4)."""
    unequal = None
    for c in ("s0", "s1", "s2"):
        x = left(c).bitwiseXOR(right(c))
        lanes = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LANES)))
        unequal = lanes if unequal is None else unequal + lanes
    chance = 1 / (1 << BITS)
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles. component_id is the
    smallest id reachable; the document of that id is kept. Texts without words (and null texts) are linked with nothing. Rows
    without an id are compared with nothing: their component is null and they are kept. Rows of one id are one document each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, width: int, percent: int, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, component (null for rows that are linked with no other text and have no copy), and the long columns ``more``, of each row of ``docs`` (doc_id long, text string)."""
    with Scratch(docs.sparkSession) as work:
        facts = ["s0", "s1", "s2", *(f"b{i}" for i in range(BANDS))]
        signed = work.table(signatures(docs, width, more), "signatures")
        comparable = signed.filter(F.col("k0").isNotNull() & F.col("doc_id").isNotNull())
        nodes = comparable.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), *(F.min(c).alias(c) for c in facts))
        nodes = work.table(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
        share = percent / 100
        least, least_long = least_estimate(share, HASHES, BITS), least_estimate(share, 64 * LONGS, 1)

        def may_link(left, right) -> Column:
            sizes = 100 * F.least(left("n"), right("n")) >= percent * F.greatest(left("n"), right("n"))
            return sizes & (estimate(left, right) >= least)

        def may_link_sharper(left, right) -> Column:
            return may_link(left, right) & (long_estimate(left, right) >= least_long)

        def of_texts(make: Callable[[DataFrame, int], DataFrame], keys: DataFrame, scope: Scratch, label: str) -> DataFrame:
            """What ``make`` finds for the texts of the given nodes: node and its columns but the set's key."""
            wanted = scope.table(nodes.select("node", "k0", "k1", "first_id").join(keys, "node"), "wanted")
            texts = possible(docs, F.col("doc_id"), wanted.select("first_id"), wanted.count())  # other texts that pass do no harm: the join on keys is exact
            found = make(texts, width).join(wanted.select("k0", "k1", "node"), ["k0", "k1"]).drop("k0", "k1")
            return scope.table(found.groupBy("node").agg(*(F.first(c).alias(c) for c in found.columns if c != "node")), label)

        def sharper(keys: DataFrame, scope: Scratch) -> DataFrame:
            return of_texts(long_signatures, keys, scope, "long-signatures")

        def verify(pairs: DataFrame, scope: Scratch) -> DataFrame:
            sets = of_texts(full_sets, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), scope, "sets")
            both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
            both = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("common"))
            return both.select("a", "b", (100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).alias("linked"))

        keys = F.array(*(f"b{i}" for i in range(BANDS))).alias("keys")
        components = linked_groups(nodes.select("node", keys, "n", "s0", "s1", "s2"), may_link, verify, sharper, may_link_sharper, first=8, within=work)
        # only sets with copies or links: the others' rows need no join
        placed = nodes.select("k0", "k1", "node", "rows", "first_id").join(components, "node", "left").filter((F.col("rows") > 1) | F.col("component").isNotNull())
        placed = work.table(placed.select("k0", "k1", "first_id", F.coalesce("component", "node").alias("component")), "grouped-sets")
        smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
        of_set = work.table(placed.join(smallest, "component").select("k0", "k1", "component", "component_id"), "components")
        rows = signed.select("doc_id", "n_shingles", *more, *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("k0", "k1")))
        found = rows.join(of_set, ["k0", "k1"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component", *more)
        return materialise(found, "near-duplicates")


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with their own columns: one row of each group, that of the smallest id. Rows equal in id and text count as one document, of which one row stays; rows that share an id alone are documents of their own.

    Rows without an id or without words all stay, but equal ones only once where they have an id. An empty table gives none.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), row_key(doc_id, text).alias("key")).select("doc_id", "text", "key.k0", "key.k1")
    found = _grouped(rows.withColumnsRenamed({"k0": "r0", "k1": "r1"}), width, percent, ("r0", "r1")).filter(F.col("doc_id").isNotNull()).select("doc_id", "component", "r0", "r1")
    first = found.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "r0", "r1")).alias("first"))
    placed = found.filter(F.col("component").isNotNull()).join(first, "component").select("r0", "r1", ((F.col("r0") == F.col("first.r0")) & (F.col("r1") == F.col("first.r1"))).alias("stays"))
    placed = placed.union(found.filter(F.col("component").isNull()).select("r0", "r1", F.lit(True)))
    changed = materialise(placed.groupBy("r0", "r1").agg(F.count(F.lit(1)).alias("n"), F.min("stays").alias("stays")).filter((F.col("n") > 1) | ~F.col("stays")), "changed")
    names = [free_name(c, docs) for c in ("r0", "r1")]
    key = row_key(doc_id, text)
    keyed = docs.select(*own_columns(docs), *(key[f"k{i}"].alias(c) for i, c in enumerate(names)))
    marked = lambda rows: rows.select(*(F.col(f"r{i}").alias(c) for i, c in enumerate(names)))
    rest = keyed.join(marked(changed.filter(~F.col("stays"))), names, "left_anti")
    repeated = marked(changed.filter("stays"))
    if repeated.isEmpty():
        return rest.select(*own_columns(docs))
    once = rest.join(repeated, names, "left_semi").dropDuplicates(names).select(*own_columns(docs))
    return rest.join(repeated, names, "left_anti").select(*own_columns(docs)).unionByName(once)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(len(w), 4) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.reach FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
