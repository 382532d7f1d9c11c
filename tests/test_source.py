from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog import operators as op
from tidelog import config, sources
from tidelog.codec import Entry, encode_record
from tidelog.errors import LogReadError, TruncatedRecord
from tidelog.schema import ENTRY_SCHEMA
from tidelog.streaming import latest_view, log_stream


def put(folder, file_id, *entries, cut=0):
    data = b"".join(map(encode_record, entries))
    (folder / sources.file_name(file_id)).write_bytes(data[: len(data) - cut])


def read(spark, folder, **options):
    sources.register(spark)
    return spark.read.format("kvwal").options(**options).load(str(folder))


def seqs(df):
    return [r["seq"] for r in df.orderBy("seq", "file_id", "ord").collect()]


def three_files(folder):
    put(folder, 1, Entry(b"k1", 10, 0, b"v1"), Entry(b"k2", 20, 0, b"v2"))
    put(folder, 2, Entry(b"k3", 30, 0, b"v3"), Entry(b"k1", 40, 1))
    put(folder, 3, Entry(b"k4", 50, 2, b"v4", 8888))


def test_names():
    assert [sources.file_name(i) for i in (1, 42, 123456789)] == ["000000001.wal", "000000042.wal", "123456789.wal"]


def test_many_files(spark, tmp_path):
    three_files(tmp_path)
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "abc.wal").write_text("x")
    (tmp_path / "7.wal").mkdir()
    df = read(spark, tmp_path)
    assert seqs(df) == [10, 20, 30, 40, 50] and tuple(op.recovery_summary(df).first()) == (5, 50)
    last = df.filter("seq = 50").first()
    assert (bytes(last["key"]), last["tag"], bytes(last["value"]), last["expire_at"], last["file_id"], last["ord"]) == (b"k4", 2, b"v4", 8888, 3, 0)
    assert seqs(read(spark, tmp_path, min_seq="40")) == [40, 50]


def test_bounds_reach_the_reader(spark, tmp_path):
    three_files(tmp_path)
    df = op.recover(read(spark, tmp_path), 25)
    assert seqs(df) == [30, 40, 50] and seqs(read(spark, tmp_path).filter("seq > 40")) == [50]
    assert seqs(read(spark, tmp_path).filter("seq = 30")) == [30] and seqs(op.recover(read(spark, tmp_path), 100)) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull(seq) AND (seq" not in plan


def test_empty_and_missing(spark, tmp_path):
    assert tuple(op.recovery_summary(read(spark, tmp_path)).first()) == (0, 0)
    with pytest.raises(Exception, match="can't list"):
        read(spark, tmp_path / "none").count()


def test_damage(spark, tmp_path):
    put(tmp_path, 1, Entry(b"a", 1, 0, b"v"), Entry(b"b", 2, 0, b"v"), cut=1)
    put(tmp_path, 2, Entry(b"c", 3, 0, b"v"))
    assert seqs(read(spark, tmp_path)) == [1, 3]
    with pytest.raises(Exception, match="ends within"):
        read(spark, tmp_path, strict="true").count()
    put(tmp_path, 1, Entry(b"a", 1, 0, b"v"))
    put(tmp_path, 2, Entry(b"c", 3, 0, b"v"), cut=1)
    assert seqs(read(spark, tmp_path, strict="true")) == [1]
    data = bytearray((tmp_path / sources.file_name(1)).read_bytes())
    data[-1] ^= 1
    (tmp_path / sources.file_name(1)).write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        read(spark, tmp_path).count()


def test_write_append_overwrite(spark, tmp_path):
    sources.register(spark)
    rows = [(bytes(range(256)), 1, 0, bytes(range(255, -1, -1)), None), (b"", 2, 1, None, None), (b"k" * 1024, 3, 2, b"v" * (1 << 20), 9)]
    df = spark.createDataFrame(rows, ENTRY_SCHEMA).repartition(2, "seq")
    folder = tmp_path / "log"
    df.write.format("kvwal").mode("append").save(str(folder))
    df.withColumn("seq", F.col("seq") + 10).write.format("kvwal").mode("append").save(str(folder))
    back = read(spark, folder)
    assert seqs(back) == [1, 2, 3, 11, 12, 13] and not list(folder.glob("*.tmp"))
    got = {r["seq"]: (bytes(r["key"]), r["tag"], None if r["value"] is None else bytes(r["value"]), r["expire_at"]) for r in back.collect()}
    assert all(got[s] == (k, t, v, e) for k, s, t, v, e in rows)
    df.filter("seq = 1").write.format("kvwal").mode("overwrite").save(str(folder))
    assert seqs(read(spark, folder)) == [1]


def test_delete_file(tmp_path):
    put(tmp_path, 1, Entry(b"a", 1, 0, b"v"))
    sources.delete_file(str(tmp_path), 1)
    assert sources.log_files(str(tmp_path)) == []
    with pytest.raises(LogReadError):
        sources.delete_file(str(tmp_path), 999)


def test_stream(spark, tmp_path):
    three_files(tmp_path)
    query = latest_view(log_stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("view").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    got = {bytes(r["key"]): (r["seq"], r["tag"]) for r in spark.table("view").collect()}
    assert got == {bytes(r["key"]): (r["seq"], r["tag"]) for r in op.latest(read(spark, tmp_path)).collect()}


def test_stream_options(spark, tmp_path, caplog):
    three_files(tmp_path)
    stream = sources.LogStream({"path": str(tmp_path), "min_seq": "40", "strict": "true"})
    parts = stream.partitions({"file_id": -1}, stream.latestOffset())
    assert [r for p in parts for b in stream.read(p) for r in b.column("seq").to_pylist()] == [40, 50]
    put(tmp_path, 0, Entry(b"late", 60, 0, b"v"))
    put(tmp_path, 4, Entry(b"a", 70, 0, b"v"), Entry(b"b", 80, 0, b"v"), cut=1)
    with caplog.at_level("WARNING", logger="tidelog.sources"):
        parts = stream.partitions({"file_id": 3}, stream.latestOffset())
    assert "log files [0]" in caplog.text and [p.file_id for p in parts] == [4]
    with pytest.raises(TruncatedRecord):
        list(stream.read(parts[0]))


def test_encoded_records_are_written_as_they_are(spark, tmp_path):
    rows = [(b"k" * i, i, i % 3, None if i % 3 == 1 else b"v" * i, i if i % 3 == 2 else None) for i in range(20)]
    sources.write_log(spark.createDataFrame(rows, ENTRY_SCHEMA), str(tmp_path / "log"))
    got = read(spark, tmp_path / "log").orderBy("seq").collect()
    assert [(bytes(r["key"]), r["seq"], r["tag"], None if r["value"] is None else bytes(r["value"]), r["expire_at"]) for r in got] == rows


def test_folder_of_the_configuration(spark, tmp_path, monkeypatch):
    three_files(tmp_path)
    monkeypatch.setattr(config, "_config", config.Config(config.Storage(str(tmp_path))))
    assert sources.LogSource({}).options["path"] == str(tmp_path) and sources.LogSource({"path": "/x"}).options["path"] == "/x"


def test_decode_records(spark):
    good = encode_record(Entry(b"k", 1, 2, b"v", 9))
    rows = spark.createDataFrame([(1, good), (2, good[:-1]), (3, b""), (4, None), (5, good + b"tail")], "n long, record binary")
    got = {r["n"]: (r["error"], r["seq"], r["expire_at"]) for r in sources.decode_records(rows).collect()}
    assert got == {1: (None, 1, 9), 2: ("TruncatedRecord", None, None), 3: (None, None, None), 4: (None, None, None), 5: (None, 1, 9)}
