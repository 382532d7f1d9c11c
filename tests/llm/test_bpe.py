from __future__ import annotations

import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from tidelog.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTENT = open(PATH, "rb").read()  # noqa: SIM115
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.ByteBPE(CONTENT)
CACHE = bpe.packer(OURS)
ODD = ["", " ", "\n", "  a b\n\nc \n d\t e", "<|endoftext|>x <|endoftext|>", "don't  we'll 123 4५", "ՙ ԱX \x85 \x1c a\xa0\xa0b", "漢字 😀😀 é", "a" * 3000 + " " * 50 + "b", "　x   y", "\x1f!", "ab \x00 c"]


def check(text: str) -> None:
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    packed = CACHE.packed(text)
    got = list(struct.unpack(f"<{len(packed) // 4}I", packed))
    assert got == want
    assert OURS.decode(got) == LIBRARY.decode(want, skip_special_tokens=False) == OURS.decode_all([packed])[0].decode()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\taB'sé1!　\x85漢\x1f՘") | st.characters(codec="utf-8", max_codepoint=0x24F), max_size=30))
def test_any_text(text):
    check(text)


def test_generations_of_the_cache():
    small = bpe.ChunkCache(CACHE.encode, OURS.special, OURS.special_split, entries=3, longest=4)
    text = "one two three four five one two six seventeen one"
    assert small.packed(text) == CACHE.packed(text) and len(small) <= 3 and len(small.old) <= 3


def test_query(spark):
    got = {r["doc_id"]: r for r in queries.op5_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"], add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows(spark):
    rows = [(1, None, "x", [1]), (None, "", "y", None), (3, "hello hello\nworld", None, [2]), (3, "hello hello\nworld", None, [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, more array<int>")
    got = bpe.encode_documents(docs, PATH)
    assert got.columns == ["doc_id", "text", "more", "ids", "decoded"]
    assert sorted((str(r["doc_id"]), len(r["ids"]), r["decoded"]) for r in got.collect()) == sorted([("1", 0, ""), ("None", 0, ""), *[("3", len(LIBRARY.encode("hello hello\nworld").ids), "hello hello\nworld")] * 2])
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_working_set_of_a_batch():
    """Decoding a run takes about 25 bytes a byte of text in each worker, so runs are small; no text is lost between them."""
    from tidelog.llm.bpe import slices

    runs = list(slices(str(i).zfill(1000) for i in range(4500)))
    assert [t for run in runs for t in run] == [str(i).zfill(1000) for i in range(4500)]
    assert max(sum(map(len, run)) for run in runs) <= 1_000_000
