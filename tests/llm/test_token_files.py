from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from tidelog.llm import queries, token_files
from tidelog.llm.token_files import EliasFano, Shard

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@given(st.lists(st.integers(0, 5000), max_size=700), st.sampled_from([1, 7, 1000]))
def test_elias_fano(gaps, scale):
    values = np.cumsum(np.array(gaps, dtype=np.int64) * scale)
    coded = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert list(coded) == values.tolist()
    assert [coded.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1000, 10_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 < 10_000 * (2 + 9 + 1) + 1000
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        EliasFano.of(np.array([2])).select(1)


def want(docs):
    start, out = 0, []
    for doc_id, text in sorted(docs):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op10_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == want(docs)


def test_files(spark, tmp_path):
    rows = [(5, "five"), (2, None), (9, "word " * 5000), (3, ""), (7, "seven seven"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = token_files.write_token_files(docs, PATH, f"file://{tmp_path}/tokens")
    paths = [r["path"] for r in manifest.orderBy("shard").collect()]
    assert not list((tmp_path / "tokens").glob("*.tmp"))
    seen = []
    for path in paths:
        shard = Shard(path)
        assert shard.width == 2
        for i in range(len(shard)):
            seen.append((shard.doc_id(i), shard.ids(i).tolist()))
        assert [(d, ids.tolist()) for d, _, ids in shard.documents(most=3)] == seen[-len(shard) :]
    assert [d for d, _ in seen] == [None, 2, 3, 5, 7, 9]
    assert all(ids == [*LIBRARY.encode(dict(rows)[d] or "").ids, 2] for d, ids in seen)
    data = bytearray(open(paths[0].removeprefix("file://"), "rb").read())  # noqa: SIM115
    data[-20] ^= 1
    broken = tmp_path / "broken.tok"
    broken.write_bytes(bytes(data))
    with pytest.raises(ValueError):
        Shard(str(broken))
    broken.write_bytes(bytes(data[:-1]))
    with pytest.raises(ValueError):
        Shard(str(broken))


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (1, None)], "doc_id long, text string")
    got = sorted(map(tuple, token_files.token_file_digest(docs, PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 1, 1] and got[0][1] == 0 and sum(r[2] for r in got) == 5
    assert token_files.token_file_digest(docs.limit(0), PATH).count() == 0


def test_far_ids_and_other_columns(spark, tmp_path):
    rows = [(-(1 << 63), "a", 1, 2), ((1 << 63) - 1, "b", 3, 4), (-5, "c", 5, 6), (0, "d", 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, path long").coalesce(1)
    manifest = token_files.write_token_files(docs, PATH, f"file://{tmp_path}/far")
    found = [d for r in manifest.orderBy("shard").collect() for d, _, _ in Shard(r["path"]).documents()]
    assert found == sorted(r[0] for r in rows)
    assert sorted(r["doc_id"] for r in token_files.digest_token_files(manifest).collect()) == found


def test_a_second_attempt_leaves_the_first_file(tmp_path):
    for attempt in (1, 2):
        writer = token_files.ShardWriter(f"{tmp_path}/shard-000000-{attempt}.tok", 4)
        writer.write([7], [struct.pack("<2I", 70_000, 2)])
        writer.close()
    assert [Shard(str(p)).ids(0).tolist() for p in sorted(tmp_path.iterdir())] == [[70_000, 2]] * 2
