"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A shard is: the ids (u16 if the vocabulary allows, else u32, little-endian), then the footer (document ids and
boundaries, both Elias-Fano coded), then its checksum (u32) and length (u64), the id width (u8) and the magic. The ids are streamed, so
a writer holds one Arrow batch and 16 bytes a document. Shards follow one another in ascending document id. A shard's file bears its
task attempt's number; those that count are listed in the manifest.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.bpe import ByteBPE, ChunkCache, byte_symbols
from tidelog.llm.common import broadcast_file, map_arrow, shared_path

MAGIC = b"TLTOKEN1"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value, with select.

    The upper bits are a unary bit vector, of which every SAMPLE-th one's place is stored with it (a quarter of a bit a value); lower bits are packed.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sampled: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sampled = n, low_bits, low, high, sampled

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if (values[1:] < values[:-1]).any():
            raise ValueError("values must not decrease")
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros((n, low_bits), dtype=np.uint8)
        for b in range(low_bits):
            low[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        high[places] = 1
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::SAMPLE].astype("<i8"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.sampled.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<i8", -(-n // SAMPLE), at + a + b))

    def lower(self, i: int) -> int:
        """The i-th value's lower bits."""
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        word = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return word >> (first & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest kept place, scan bytes of the upper bits by their counts of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.sampled[i // SAMPLE])
        byte, left = place // 8, i % SAMPLE + 1
        word = int(self.high[byte]) >> (place % 8) << (place % 8)
        while (ones := word.bit_count()) < left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left - 1):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self.lower(i)

    def from_sample(self, k: int) -> list[int]:
        """The values from the k-th kept place up to the next: at most SAMPLE of them, found in one scan."""
        first, last = k * SAMPLE, min((k + 1) * SAMPLE, self.n)
        begin = int(self.sampled[k])
        end = int(self.sampled[k + 1]) if last < self.n else len(self.high) * 8
        bits = np.unpackbits(self.high[begin >> 3 : (end + 7) >> 3], bitorder="little")
        places = np.flatnonzero(bits[begin & 7 :])[: last - first] + begin
        return [(int(p) - i) << self.low_bits | self.lower(i) for i, p in enumerate(places, first)]

    def __iter__(self) -> Iterator[int]:
        """All values in order, SAMPLE of them held at a time."""
        for k in range(len(self.sampled)):
            yield from self.from_sample(k)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path or URI, as an executor sees it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


class ShardWriter:
    """Streams documents' ids, ordered by document id with nulls first, to a shard; the file appears under its name only when it is whole."""

    def __init__(self, path: str, width: int):
        self.store, self.path = open_store(path)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.tmp"
        self.out = self.store.open_output_stream(self.temporary)
        self.width, self.nulls, self.n = width, 0, 0
        self.doc_ids, self.ends = array("q"), array("q")

    def write(self, doc_ids: Iterable[int | None], packed: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(packed), dtype="<u4")
        self.out.write((flat.astype("<u2") if self.width == 2 else flat).tobytes())
        for d, p in zip(doc_ids, packed, strict=True):
            self.n += len(p) // 4
            self.ends.append(self.n)
            if d is None:
                self.nulls += 1
            else:
                self.doc_ids.append(d)

    def close(self) -> tuple[int, int]:
        base = self.doc_ids[0] if self.doc_ids else 0
        above = np.array(self.doc_ids, dtype=np.int64).view(np.uint64) - np.array(base, dtype=np.int64).view(np.uint64)  # modulo 2**64, as from the smallest to the largest BIGINT
        ids, ends = EliasFano.of(above).to_bytes(), EliasFano.of(np.array(self.ends, dtype=np.int64)).to_bytes()
        footer = struct.pack("<QQqQ", self.nulls, self.n, base, len(ids)) + ids + ends
        self.out.write(footer + struct.pack("<IQB", zlib.crc32(footer), len(footer), self.width) + MAGIC)
        self.out.close()
        self.store.move(self.temporary, self.path)
        return len(self.ends), self.n


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, path: str):
        store, at = open_store(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        tail = struct.calcsize("<IQB") + len(MAGIC)
        end = self.file.read_at(tail, size - tail) if size >= tail else b""
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is not a whole token shard")
        crc, length, self.width = struct.unpack_from("<IQB", end)
        footer = self.file.read_at(length, size - tail - length)
        if zlib.crc32(footer) != crc:
            raise ValueError(f"{path}: the footer's checksum does not match")
        self.nulls, self.n_ids, self.base, n = struct.unpack_from("<QQqQ", footer)
        at = struct.calcsize("<QQqQ")
        self.known, self.ends = EliasFano.from_bytes(footer[at : at + n]), EliasFano.from_bytes(footer[at + n :])

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        """The i-th document's id; those without one come first."""
        return None if i < self.nulls else self.base + self.known.select(i - self.nulls)

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def read(self, start: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        """The i-th document's ids."""
        return self.read(*self.span(i))

    def documents(self, most: int = 4_000_000) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of every document in order, reading about ``most`` ids at a time. Boundaries are decoded as they are met."""
        known, block, begin, start = iter(self.known), np.zeros(0, dtype="<u4"), 0, 0
        for i, end in enumerate(self.ends):
            if end > begin + len(block):
                begin, block = start, self.read(start, max(end, min(start + most, self.n_ids)))
            yield None if i < self.nulls else self.base + next(known), start, block[start - begin : end - begin]
            start = end


_ENCODERS: dict[int, ChunkCache] = {}


def library_packer(content: bytes) -> ChunkCache:
    """This worker's encoder: the tokenizers library's model behind a bounded cache of chunks."""
    key = hash(content)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        rules, model = ByteBPE(content), Tokenizer.from_str(content.decode()).model
        symbol_of = {b: s for s, b in byte_symbols().items()}
        tokenize, as_id = model.tokenize, struct.Struct("<I").pack

        def encode(chunk: str) -> bytes:
            return b"".join([as_id(t.id) for piece in rules.pieces(chunk) for t in tokenize("".join([symbol_of[b] for b in piece.encode()]))])

        _ENCODERS.clear()
        _ENCODERS[key] = ChunkCache(encode, rules.special, rules.special_split)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and write the ids to shards under ``folder`` in ascending document id. Other columns are not read.

    Null ids come first, rows of one id in the order of their texts' hash; a null text is empty. ``end_id``, if
    given, is appended to each document. Returns the manifest: shard, path, n_docs, n_ids, start (ids in all shards before). It is
    written to ``folder``/manifest, so the shards exist when this returns. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    held = broadcast_file(spark, vocabulary)
    with open(vocabulary, "rb") as f:
        rules = ByteBPE(f.read())
    width = 2 if max(max(rules.bytes_of), end_id or 0) < 1 << 16 else 4
    end = b"" if end_id is None else struct.pack("<I", end_id)
    tie = F.xxhash64("text")
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def write(batches):
        from pyspark import TaskContext

        cache, writer, shard = library_packer(held.value), None, TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.tok"  # a twin of this task writes another file
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for at in range(0, batch.num_rows, 256):
                if writer is None:
                    writer = ShardWriter(path, width)
                writer.write(ids.slice(at, 256).to_pylist(), [cache.packed(t) + end for t in texts.slice(at, 256).to_pylist()])
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with each shard's start. One row a shard goes through the window, not one a document."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema("shard long, path string, n_docs long, n_ids long").parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def digest_token_files(manifest: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, start, n_tokens, ids_crc32 of every document, a task a shard."""

    def make():
        def step(batch: pa.RecordBatch):
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[list] = [[], [], [], []]
                for doc, at, ids in Shard(path).documents():
                    for column, x in zip(rows, (doc, start + at, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return step

    spread = manifest.select("path", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return map_arrow(spread, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, vocabulary: str, *, end_id: int = 2) -> DataFrame:
    """Write to a fresh folder of the shared checkpoint directory, read back and digest."""
    return digest_token_files(write_token_files(docs, vocabulary, shared_path(docs.sparkSession, "tokens"), end_id=end_id))
