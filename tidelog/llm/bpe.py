"""BPE encoding and decoding with a byte-level vocabulary.

The encoder keeps the symbols of a pre-token in a doubly linked list and takes merges from a
priority queue of (rank, position); entries whose symbols have since changed are stale and skipped.
Decoding concatenates the vocabulary's byte strings. A text is first cut into chunks (white space and
the run that follows it), which the vocabulary's splitting rule never crosses, so a chunk's ids can be
kept in a bounded cache.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WHITE_SPACE, broadcast_file, map_arrow, numbered, texts_of, with_text

#: The vocabulary's splitting rule (fixed value, published with the vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point, Python's character classes and the tokenizers library's agree.
PLAIN_LIMIT = "ɐ"


def byte_symbols() -> dict[str, int]:
    """Symbol of the vocabulary file -> byte: printable bytes stand for themselves, the others for U+0100 and up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, content: bytes | str):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level BPE vocabulary without normaliser")
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: as_bytes(s) for s, i in model["vocab"].items()}
        id_of = model["vocab"]
        self.first = [0] * 256
        for s, b in symbols.items():
            self.first[b] = id_of[s]
        #: (left id << 32 | right id) -> (rank << 32 | merged id)
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[id_of[a] << 32 | id_of[b]] = rank << 32 | id_of[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self._flat = None
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self._library = None

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges, push, pop = self.merges.get, heapq.heappush, heapq.heappop
        queue = []
        for i in range(n - 1):
            hit = merges(ids[i] << 32 | ids[i + 1])
            if hit is not None:
                queue.append((hit >> 32, i, hit & 0xFFFFFFFF, ids[i], ids[i + 1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, merged, a, b = pop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # stale: a neighbour was merged meanwhile
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                hit = merges(merged << 32 | ids[k])
                if hit is not None:
                    push(queue, (hit >> 32, i, hit & 0xFFFFFFFF, merged, ids[k]))
            h = before[i]
            if h >= 0:
                hit = merges(ids[h] << 32 | merged)
                if hit is not None:
                    push(queue, (hit >> 32, h, hit & 0xFFFFFFFF, ids[h], merged))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if text.isascii() or max(text) < PLAIN_LIMIT:
            return self.split.findall(text)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_plain(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            out += self.merge(piece.encode())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD. Special tokens keep their text."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


    def decode_all(self, packed: list[bytes]) -> list[bytes]:
        """UTF-8 of the texts of many packed id arrays: one gather from the concatenated vocabulary strings."""
        import numpy as np

        if self._flat is None:
            size = max(self.bytes_of) + 1
            strings = [self.bytes_of.get(i, b"") for i in range(size)]
            lengths = np.array([len(x) for x in strings], dtype=np.int32)
            self._flat = np.frombuffer(b"".join(strings), dtype=np.uint8), lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int32)
        flat, lengths, begins = self._flat
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        n = lengths[ids]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(begins[ids] - (ends - n), n)
        data, out, done, tokens = flat[at].tobytes(), [], 0, 0
        for p in packed:
            tokens += len(p) // 4
            end = int(ends[tokens - 1]) if tokens else 0
            out.append(data[done:end].decode("utf-8", "replace").encode())
            done = end
        return out


class ChunkCache(dict):
    """Whole texts to packed ids (little-endian u32), by way of a bounded cache of chunks.

    ``encode`` gives one chunk's packed ids. Two generations of at most ``entries`` chunks each are kept, the
    older one being dropped when the younger is full; chunks longer than ``longest`` are not kept.
    """

    def __init__(self, encode: Callable[[str], bytes], special: dict[str, int], special_split, entries: int = 150_000, longest: int = 64):
        super().__init__()
        self.encode, self.special, self.special_split, self.entries, self.longest = encode, special, special_split, entries, longest
        self.old: dict[str, bytes] = {}
        self.chunks = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+").findall
        odd = WHITE_SPACE.replace(" ", "").replace("\\t-\\r", "\\t\\x0b-\\r")
        self.odd_space = re.compile(f"[{odd}][ \\n]").search

    def cut(self, text: str) -> list[str]:
        """Keys of a text's chunks: the chunk itself if it starts with a line feed, what follows its single space, else the chunk behind a space.

        Where no white space precedes a space or a line feed, splitting at spaces finds the same chunks.
        """
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.odd_space(text):
            return [c if c[0] == "\n" else c[1:] if c[0] == " " and c[1:2] not in ("\n", " ") or c == " " else " " + c for c in self.chunks(text)]
        parts = text.replace("\n", " \n").split(" ")
        if parts[0]:
            parts[0] = " " + parts[0]
        else:
            del parts[0]
        return parts

    @staticmethod
    def whole(key: str) -> str:
        """The chunk of a key."""
        return key if key[:1] == "\n" else key[1:] if key[:1] == " " else " " + key

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(self.whole(key))
            if len(key) > self.longest:
                return ids
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """Packed ids of a text."""
        if not text:
            return b""
        if self.special_split is not None and any(s in text for s in self.special):
            return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else b"".join(map(self.__getitem__, self.cut(p))) for p in self.special_split.split(text) if p)
        return b"".join(map(self.__getitem__, self.cut(text)))


def packer(bpe: ByteBPE) -> ChunkCache:
    """Cache in front of ``bpe``, with a smaller one for pre-tokens."""
    inner: dict[str, bytes] = {}

    def encode(chunk: str) -> bytes:
        out = b""
        for piece in bpe.pieces(chunk):
            ids = inner.get(piece)
            if ids is None:
                ids = array.array("I", bpe.merge(piece.encode())).tobytes()
                if len(piece) <= 32:
                    if len(inner) >= 200_000:
                        inner.clear()
                    inner[piece] = ids
            out += ids
        return out

    return ChunkCache(encode, bpe.special, bpe.special_split)


_PACKERS: dict[int, tuple[ByteBPE, ChunkCache]] = {}


def worker_packer(content: bytes) -> tuple[ByteBPE, ChunkCache]:
    """This worker process's encoder, kept between tasks."""
    key = hash(content)
    if key not in _PACKERS:
        bpe = ByteBPE(content)
        _PACKERS.clear()
        _PACKERS[key] = bpe, packer(bpe)
    return _PACKERS[key]


def slices(texts: Iterable[str], chars: int = 1_000_000) -> Iterable[list[str]]:
    """Consecutive runs of texts of about so many characters, so that a batch's working set stays bounded (decoding takes about 25 bytes a byte of text)."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_documents(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every text's ids and the text decoded from them.

    Adds ``ids`` (array<int>) and ``decoded`` (string) to the columns ``keep`` (all, if None). A null or
    empty text has no ids and decodes to the empty text. A column named ``ids`` or ``decoded`` is replaced. No shuffle:
    each Arrow batch is encoded where it is read, whatever the texts' lengths.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("ids", "decoded")]
    held = broadcast_file(docs.sparkSession, vocabulary)
    fields = [docs.schema[c] for c in keep]

    def make():
        import numpy as np

        bpe, cache = worker_packer(held.value)

        def step(batch: pa.RecordBatch):
            start = 0
            for run in slices("" if t is None else t for t in texts_of(batch.column(at))):
                packed = [cache.packed(t) for t in run]
                counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                decoded = pa.array([t.decode() for t in bpe.decode_all(packed)], pa.string())
                part = batch.slice(start, len(run))
                start += len(run)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), ids, decoded], names=[*keep, "ids", "decoded"])

        return step

    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("ids", ArrayType(IntegerType(), True)), StructField("decoded", StringType())])
    source, at = with_text(docs, keep, text)
    return map_arrow(numbered(source), make, schema)


def encoding_digest(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of :func:`encode_documents`, computed where the ids are made: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    held = broadcast_file(docs.sparkSession, vocabulary)

    def make():
        bpe, cache = worker_packer(held.value)

        def step(batch: pa.RecordBatch):
            n, ids_sha, text_sha = [], [], []
            for run in slices("" if t is None else t for t in texts_of(batch.column("text"))):
                packed = [cache.packed(t) for t in run]
                n += [len(p) // 4 for p in packed]
                ids_sha += [hashlib.sha256(p).hexdigest() for p in packed]
                text_sha += [hashlib.sha256(t).hexdigest() for t in bpe.decode_all(packed)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
