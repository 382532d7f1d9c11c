from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import codec, config
from tidelog import functions as fn
from tidelog import operators as op
from tidelog.codec import BlockHandle, Entry
from tidelog.schema import ENTRY_SCHEMA, LOG_SCHEMA


def log(spark, *rows):
    """Rows (seq, tag, key[, value[, expire_at]]) in write order."""
    full = [(r[2].encode(), r[0], r[1], r[3].encode() if len(r) > 3 and r[3] is not None else None, r[4] if len(r) > 4 else None, 1, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LOG_SCHEMA)


def pairs(df):
    return [(bytes(r["key"]).decode(), r["seq"]) for r in df.collect()]


def test_order(spark):
    rows = log(spark, (100, 0, "key1", "v1"), (300, 0, "key2", "v3"), (200, 0, "key1", "v2"))
    got = {(bytes(r["key"]), r["seq"]): r["position"] for r in op.entry_order(rows).collect()}
    assert got == {(b"key1", 200): 1, (b"key1", 100): 2, (b"key2", 300): 3}


def test_sizes(spark):
    rows = log(spark, (1, 0, "key", "value"), (1, 1, "key"), (1, 2, "key", "value", 5)).select(fn.estimated_size().alias("e"), fn.slot_size().alias("s"), fn.record_len().alias("r"))
    assert sorted(map(tuple, rows.collect())) == [(11, 19, 32), (16, 24, 37), (24, 32, 45)]


def test_size_trajectory(spark):
    rows = log(spark, (4, 0, "lamp", "on"), (9, 0, "lamp", "dimmed to a third"), (11, 2, "fan", "slow", 60), (70_000, 0, "lamp", ""), (70_001, 1, "fan"))
    want = [4 + 2 + 16, 4 + 17 + 16, 37 + 3 + 8 + 4 + 16, 68 - 17, 51 - 12]
    for chunk in (1, 5, 1 << 16):  # the write before may stand in another chunk
        got = op.size_trajectory(rows, chunk=chunk).orderBy("seq").collect()
        assert [r["memtable_bytes"] for r in got] == want and set(got[0].asDict()) == {*rows.columns, "memtable_bytes"}
    assert op.memtable_size(rows).first()[0] == want[-1]
    assert tuple(op.flush_points(rows, 38).first()) == (11, 68)
    assert op.flush_points(rows, 69).count() == 0


def test_flush_point_of_the_configuration(spark, monkeypatch):
    monkeypatch.setattr(config, "_config", config.Config(config.Storage(memtable_size_mb=1)))
    rows = log(spark, (1, 0, "big", "x" * 600_000), (2, 0, "bigger", "y" * 600_000))
    assert op.flush_points(rows).first()["seq"] == 2


def test_bulk_accounting(spark):
    rows = [(3 * i, i % 3, f"sensor/{i % 37}", None if i % 3 == 1 else "r" * (i % 11), 5 if i % 3 == 2 else None) for i in range(260)]
    size, held = 0, {}
    for _, tag, key, value, _ in rows:
        n = len(value or "") + (8 if tag == 2 else 0)
        size += n - held[key] if key in held else len(key) + n + 16
        held[key] = n
    whole = log(spark, *rows)
    assert op.memtable_size(whole).first()[0] == size
    assert op.size_trajectory(whole, chunk=50).agg(F.max_by("memtable_bytes", "seq")).first()[0] == size


def test_mixed_operations(spark):
    rows = log(spark, (7, 0, "oslo", "rain"), (8, 0, "lima", "fog"), (12, 0, "cairo", "sun"), (15, 1, "lima"), (16, 0, "oslo", "snow"), (30, 0, "quito", "wind"), (31, 1, "nowhere"))
    assert pairs(op.snapshot(rows)) == [("cairo", 12), ("lima", 15), ("nowhere", 31), ("oslo", 16), ("quito", 30)]
    assert pairs(op.get(rows, b"lima")) == [("lima", 15)] and op.get(rows, b"rome").count() == 0
    assert pairs(op.range_scan(rows, b"lima", b"oslo")) == [("lima", 15), ("nowhere", 31)]
    assert sorted(pairs(op.compact(rows, bottom=True))) == [("cairo", 12), ("oslo", 16), ("quito", 30)]
    assert op.compact(rows, bottom=False).count() == 5
    assert sorted(pairs(op.as_of_seq(rows, 12))) == [("cairo", 12), ("lima", 8), ("oslo", 7)]


def test_clashing_columns(spark):
    names = ["n", "at", "part", "before", "chunk", "size", "change", "own", "__n", "a.b"]
    rows = log(spark, (1, 0, "k", "a"), (2, 0, "k", "bc"), (3, 1, "j")).withColumns({c: F.lit(c) for c in names})
    for got in (op.latest(rows), op.dedup_entries(rows), op.merge_tiers([rows]), op.entry_order(rows), op.size_trajectory(rows)):
        assert got.columns[: len(rows.columns)] == rows.columns
        assert all(r[c] == c for r in got.collect() for c in names)


def test_tiers_in_one_shuffle(spark):
    tiers = [log(spark, (50 - i, 0, "k", f"v{i}"), (3, 0, f"only{i}", "x")) for i in range(3)]
    merged = op.merge_tiers(tiers)
    assert sorted((bytes(r["key"]).decode(), r["seq"], r["tier"]) for r in merged.collect()) == [("k", 50, 0), ("only0", 3, 0), ("only1", 3, 1), ("only2", 3, 2)]
    assert op.merge_tiers(tiers)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_recovery_is_logged(spark, caplog):
    with caplog.at_level("INFO", logger="tidelog.operators"):
        assert op.log_recovery(log(spark, (5, 0, "a", "b"), (9, 1, "a")), 6) == (1, 9)
    assert "recovered 1 entries up to sequence 9 in" in caplog.text


def test_bloom_filter_prunes(spark, tmp_path):
    """A key that isn't there, between keys that are: with the filter no row group is read, without it one is."""
    rows = log(spark, *((i, 0, f"key{i:05d}", "v") for i in range(0, 2000, 2)))

    def read(bloom):
        path = str(tmp_path / f"table-{bloom}")
        op.flush(rows, path, bloom=bloom)
        found = spark.read.parquet(path).filter(F.col("key") == F.lit(b"key00777"))
        assert found.collect() == []
        plan = found._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().apply(0)
        return scan.metrics().apply("numOutputRows").value()

    assert read(True) == 0 and read(False) > 0


def test_arrival_order(spark):
    rows = log(spark, (2, 0, "k", "new"), (1, 0, "k", "late"))
    assert pairs(op.latest(rows)) == [("k", 2)] and pairs(op.latest(rows, order="arrival")) == [("k", 1)]
    with pytest.raises(ValueError):
        op.latest(rows, order="other")


def test_ttl_tiers_and_dedup(spark):
    rows = log(spark, (1, 2, "a", "x", 10), (2, 0, "b", ""), (3, 1, "never_existed"))
    assert sorted(pairs(op.live_at(rows, 9))) == [("a", 1), ("b", 2)] and pairs(op.live_at(rows, 10)) == [("b", 2)]
    older = log(spark, (0, 0, "never_existed", "old"), (0, 0, "c", "only here"))
    merged = {bytes(r["key"]).decode(): r["tier"] for r in op.merge_tiers([rows, older]).collect()}
    assert merged == {"a": 0, "b": 0, "never_existed": 0, "c": 1}
    assert op.dedup_entries(rows.unionByName(rows)).count() == 3


def test_empty(spark):
    none = op.empty(spark)
    assert none.schema == ENTRY_SCHEMA and op.snapshot(none).count() == 0
    assert tuple(op.recovery_summary(none).first()) == (0, 0) and op.memtable_size(none).first()[0] == 0


def test_recovery_summary(spark):
    rows = log(spark, *((s, 0, f"k{s}", "v") for s in (10, 20, 30, 40)))
    assert [tuple(op.recovery_summary(rows, m).first()) for m in (0, 25, 40, 100)] == [(4, 40), (2, 40), (1, 40), (0, 0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([0, 1, 2]), st.binary(max_size=3), st.binary(max_size=4)), min_size=1, max_size=30))
def test_snapshot_is_a_dict(spark, writes):
    rows, held = [], {}
    for i, (tag, key, value) in enumerate(writes):
        row = (key, i, tag, None if tag == 1 else value, i if tag == 2 else None, 1, i)
        rows.append(row)
        held[key] = row
    got = op.snapshot(spark.createDataFrame(rows, LOG_SCHEMA)).collect()
    assert [(bytes(r["key"]), r["seq"], r["tag"], None if r["value"] is None else bytes(r["value"])) for r in got] == [held[k][:4] for k in sorted(held)]


def test_encoders_agree_with_the_codec(spark):
    entries = [Entry(b"key1", 100, 0, b"value1"), Entry(b"gone", 200, 1), Entry(bytes(range(256)), 3, 2, bytes(range(255, -1, -1)), 1234567890), Entry(b"", 1, 0, b"")]
    df = spark.createDataFrame([(e.key, e.seq, e.tag, e.value, e.expire_at) for e in entries], ENTRY_SCHEMA)
    assert [bytes(r[0]) for r in df.select(fn.encode_record()).collect()] == [codec.encode_record(e) for e in entries]
    numbers = [0, 1, 127, 128, 300, 16383, 16384, (1 << 32) - 1, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", fn.encode_varint(F.col("n")).alias("v"), fn.varint_size(F.col("n")).alias("s"), fn.encode_handle(F.col("n"), F.col("n")).alias("h")).collect()
    for r in rows:
        assert bytes(r["v"]) == codec.encode_varint(r["n"]) and r["s"] == len(bytes(r["v"])) and bytes(r["h"]) == bytes(r["v"]) * 2


def test_decoders_agree_with_the_codec(spark):
    data = [b"", b"\x80", b"\x80" * 10, b"\x80" * 11, b"\x80\x00", b"\xff" * 9 + b"\x7f", b"\xff" * 9 + b"\x01tail", b"\x07\x80", b"\x07\x81\x01..", codec.encode_varint(1 << 63) * 2]

    def want(decode, x):
        try:
            return decode(x)
        except codec.TableDecodeError as e:
            return next(w for w in ("empty", "incomplete", "more than") if w in str(e)).replace("more than", "too long")

    df = spark.createDataFrame([(x,) for x in data], "x binary")
    x = F.col("x")
    for r in df.select("x", fn.varint_error(x).alias("e"), fn.decode_varint(x).alias("n"), fn.varint_length(x).alias("l"), fn.decode_handle(x).alias("h")).collect():
        one, two = want(codec.decode_varint, bytes(r["x"])), want(BlockHandle.decode, bytes(r["x"]))
        assert (r["e"] == one and r["n"] is None and r["l"] is None) if isinstance(one, str) else (r["e"] is None and (int(r["n"]), r["l"]) == one)
        assert r["h"] is None if isinstance(two, str) else (int(r["h"]["offset"]), int(r["h"]["size"]), r["h"]["length"]) == (two[0].offset, two[0].size, two[1])


def test_preview(spark):
    df = spark.createDataFrame([(b"ok",), (b"\xff" * 70,)], "value binary").select(fn.preview("value"))
    assert [r[0] for r in df.collect()] == ["ok", "�" * 64 + "... (70 bytes)"]


def test_filters_reach_the_scan(spark, tmp_path):
    op.flush(log(spark, (1, 0, "a", "1"), (2, 0, "b", "2")), str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = op.get(table, b"a")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key" in plan and "WindowGroupLimit" in plan
    assert pairs(op.range_scan(table, b"b")) == [("b", 2)]
