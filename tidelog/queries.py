"""Registered queries on a log derived from the events table, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import config
from tidelog import functions as fn
from tidelog import operators as op
from tidelog.codec import MAGIC, MAX_KEY
from tidelog.errors import ConfigError, LogReadError
from tidelog.plans import materialise, shared_path
from tidelog.schema import EXPIRING, NORMAL, TOMBSTONE
from tidelog.sources import decode_footers, decode_records, delete_file, log_files, register, write_log

NOW = 1706700000


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: users are keys; errors delete, sign-ups expire after a day, all else are puts; a thousand records a file."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tag = F.when(F.col("event_type") == "error", TOMBSTONE).when(F.col("event_type") == "signup", EXPIRING).otherwise(NORMAL)
    seconds = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return op.entries(
        events,
        key=F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")),
        seq=F.col("event_id"),
        tag=tag,
        value=F.col("props"),
        expire_at=seconds + 86400,
        more={"file_id": F.floor(F.col("event_id") / 1000) + 1, "ord": F.col("event_id") % 1000},
    )


def text(df: DataFrame, *more: str) -> DataFrame:
    """key and value as text, with the other columns named."""
    columns = {"key": F.col("key").cast("string").alias("key"), "value": F.col("value").cast("string").alias("value"), "tag": F.col("tag").cast("int").alias("tag")}
    return df.select(*(columns.get(c, F.col(c)) for c in more))


FULL = ("key", "seq", "tag", "value", "expire_at")
CTE = """WITH l AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id AS seq,
  CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS INTEGER) AS tag,
  CASE WHEN event_type <> 'error' THEN props END AS value,
  CASE WHEN event_type = 'signup' THEN CAST(floor(epoch(ts)) AS BIGINT) + 86400 END AS expire_at,
  event_id // 1000 + 1 AS file_id, event_id % 1000 AS ord FROM events),
n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
"""


def varint_sql(x: str) -> str:
    """Hex digits of a varint in DuckDB."""
    size = f"CAST(greatest(1, ceil(length(ltrim(bin({x}), '0')) / 7.0)) AS BIGINT)"
    return f"array_to_string([printf('%02x', (({x} >> CAST(7 * i AS BIGINT)) & 127) + CASE WHEN i < {size} - 1 THEN 128 ELSE 0 END) for i in range({size})], '')"


#: Records in hex digits, and CRC-32 by a table of 256 values that is computed from the polynomial.
CRC = """, b AS (SELECT seq, printf('%016x', 8 + strlen(key) + strlen(coalesce(value, '')) + CASE WHEN tag = 2 THEN 8 ELSE 0 END) || printf('%02x', tag) || printf('%016x', seq) || printf('%016x', strlen(key))
  || lower(hex(encode(key))) || CASE WHEN tag = 2 THEN printf('%016x', expire_at) ELSE '' END || lower(hex(encode(coalesce(value, '')))) AS body FROM l),
s AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(i)),
t AS (SELECT list(c ORDER BY i) AS t FROM s),
c AS (SELECT seq, body, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST((strpos('0123456789abcdef', substr(body, 2 * j + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(body, 2 * j + 2, 1)) - 1 AS BIGINT) for j in range(length(body) // 2)]),
  lambda x, y: xor(x >> 8, t.t[(xor(x, y) & 255) + 1])), 4294967295) AS crc FROM b, t)
"""
SERIALIZED = "coalesce(strlen(value), 0) + CASE WHEN tag = 2 THEN 8 ELSE 0 END"


def wal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written to log files in the shared folder, one task a file, and read back."""
    register(spark)
    folder = shared_path(spark, "wal")
    write_log(log_view(spark, sf_dir), folder)
    return text(spark.read.format("kvwal").load(folder), *FULL)


def wal_file_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two log files written one after the other; the first deleted; what is left."""
    register(spark)
    folder, log = shared_path(spark, "wal"), log_view(spark, sf_dir)
    for file_id in (1, 2):
        write_log(log.filter(F.col("file_id") == file_id).coalesce(1), folder)
    delete_file(folder, 1)
    return text(spark.read.format("kvwal").load(folder), *FULL, "file_id")


def wal_missing_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the error that listing a folder that is not there gives."""
    try:
        log_files(shared_path(spark, "none"))
        error = None
    except LogReadError as e:
        error = type(e).__name__
    return spark.createDataFrame([(error,)], "error string")


def wal_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded records, seven in eight of them damaged in one of seven ways, and what decoding says."""
    record, body = F.col("record"), F.col("record")
    rest = lambda at: F.expr(f"substring(record, {at})")
    other_tag = F.concat(F.substring(body, 5, 8), F.unhex(F.lit("03")), rest(14))
    key_of = lambda n: F.concat(F.substring(record, 1, 21), fn.big_endian(F.lit(n), 8), rest(30))
    ways = [
        record,
        F.concat(fn.big_endian(fn.record_crc().bitwiseXOR(F.lit(1).cast("long")), 4), rest(5)),
        F.expr("substring(record, 1, octet_length(record) - 1)"),
        F.expr("substring(record, 1, cast(seq % 20 + 1 as int))"),
        F.unhex(F.lit("")),
        F.concat(fn.big_endian(F.crc32(other_tag), 4), other_tag),
        key_of(MAX_KEY + 1),
        key_of(MAX_KEY),
    ]
    damaged = F.coalesce(*(F.when(F.col("seq") % len(ways) == i, w) for i, w in enumerate(ways)))
    records = log_view(spark, sf_dir).withColumn("record", fn.encode_record()).select(F.col("seq").alias("n"), damaged.alias("record"))
    return decode_records(records).select("n", "error", F.col("key").cast("string").alias("key"))


def table_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest versions flushed to a table and read back."""
    folder = shared_path(spark, "table")
    op.flush(log_view(spark, sf_dir), folder)
    return text(spark.read.parquet(folder), *FULL)


def varint_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Varints with other bytes behind them, decoded on columns."""
    cube = F.col("seq") * F.col("seq") * F.col("seq")
    data = F.col("data")
    stored = materialise(log_view(spark, sf_dir).select("seq", F.concat(fn.encode_varint(cube), F.unhex(F.lit("FF00"))).alias("data")))
    return stored.select("seq", fn.decode_varint(data).cast("long").alias("number"), fn.varint_length(data).cast("long").alias("length"))


def varint_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("seq") % 4 == 0, 0).when(F.col("seq") % 4 == 1, F.col("seq") % 9 + 1).when(F.col("seq") % 4 == 2, 10).otherwise(11)
    data = F.unhex(F.repeat(F.lit("80"), n.cast("int")))
    return log_view(spark, sf_dir).select("seq", fn.varint_error(data).alias("error"), fn.decode_varint(data).cast("long").alias("number"))


def handle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(log_view(spark, sf_dir).select("seq", fn.encode_handle(F.col("seq"), F.col("seq") * F.col("seq")).alias("data")))
    handle = fn.decode_handle(F.col("data"))
    return stored.select("seq", handle["offset"].cast("long").alias("offset"), handle["size"].cast("long").alias("size"), handle["length"].alias("length"))


def footer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers, every fifth with another mark and every seventh without its first byte, and what decoding says."""
    rows = log_view(spark, sf_dir).withColumn("footer", fn.encode_footer(fn.encode_handle(F.col("seq"), F.col("seq") * 3), fn.encode_handle(F.col("seq") * F.col("seq"), F.lit(7))))
    rows = rows.withColumn("footer", F.when(F.col("seq") % 5 == 0, F.concat(F.substring("footer", 1, 47), F.unhex(F.lit("00")))).otherwise(F.col("footer")))
    rows = rows.withColumn("footer", F.when(F.col("seq") % 7 == 0, F.substring("footer", 2, 47)).otherwise(F.col("footer")))
    found = decode_footers(rows.select("seq", "footer"))
    return found.select("seq", F.lower(F.hex("footer")).alias("footer"), F.col("meta_size").cast("long").alias("meta_size"), F.col("index_offset").cast("long").alias("index_offset"), "valid_magic", "error")


def memtable_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty memory table's size and entries."""
    none = op.empty(spark)
    return op.recovery_summary(none).withColumn("bytes", F.lit(op.memtable_size(none).first()["bytes"]))


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default, a value of a file, an override, and settings that are refused."""
    with tempfile.TemporaryDirectory() as folder:  # of the driver alone: configuration files are its own
        Path(folder, "config.toml").write_text("[storage]\nmemtable_size_mb = 12\n[server]\nport = 5100\n")
        given = {"TIDELOG__STORAGE__DATA_DIR": f"{folder}/data"}

        def outcome(**more: str) -> str:
            try:
                loaded = config.load(given | more, folder)
                return f"{loaded.server.host} {loaded.server.port} {loaded.storage.memtable_size_mb}"
            except ConfigError as e:
                return type(e).__name__

        changes = {"file": {}, "override": {"TIDELOG__SERVER__PORT": "6200"}, "host name": {"TIDELOG__SERVER__HOST": "db.internal"}, "port": {"TIDELOG__SERVER__PORT": "70000"}, "size": {"TIDELOG__STORAGE__MEMTABLE_SIZE_MB": "0"}, "no number": {"TIDELOG__SERVER__PORT": "x"}, "no file": {"TIDELOG_CONFIG": f"{folder}/none.toml"}}
        return spark.createDataFrame([(name, outcome(**more)) for name, more in changes.items()], "name string, outcome string")


def tiered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_view(spark, sf_dir)
    tiers = [log.filter("seq >= 9800"), log.filter("seq >= 9000 AND seq < 9800"), log.filter("seq < 9000")]
    return text(op.merge_tiers(tiers), "key", "seq", "tag", "value", "tier")


def entry_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_view(spark, sf_dir)
    twice = log.unionByName(log.filter(F.col("tag") == EXPIRING).withColumn("value", F.lit("other").cast("binary")))
    return op.dedup_entries(twice).agg(F.count(F.lit(1)).alias("entries"))


def varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = F.col("seq") * F.col("seq") * F.col("seq")
    return log_view(spark, sf_dir).select("seq", F.lower(F.hex(fn.encode_varint(cube))).alias("encoded"), fn.varint_size(cube).alias("size"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_view(spark, sf_dir).select("seq", fn.estimated_size().alias("estimated_size"), fn.slot_size().alias("slot_size"), fn.record_len().alias("record_len"))


def tag_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_view(spark, sf_dir)
    return log.groupBy(F.col("tag").cast("int").alias("tag")).agg(F.count(F.lit(1)).alias("entries"), F.sum(fn.data_len()).alias("data_bytes"), F.sum(fn.meta_len()).alias("meta_bytes"))


def wal_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_view(spark, sf_dir).select("seq", fn.record_crc().alias("crc"), F.lower(F.hex(fn.encode_record())).alias("record"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    log = log_view
    return {
        "wal_recover": lambda s, d: text(op.recover(log(s, d), 2500), *FULL),
        "wal_recover_ordered": lambda s, d: text(op.recover_ordered(log(s, d), 9000), *FULL),
        "wal_recover_summary": lambda s, d: op.recovery_summary(log(s, d), 2500),
        "wal_recover_summary_empty": lambda s, d: op.recovery_summary(log(s, d), 1 << 40),
        "wal_file_stats": lambda s, d: op.file_stats(log(s, d)),
        "wal_crc": wal_crc,
        "wal_roundtrip": wal_roundtrip,
        "wal_file_deleted": wal_file_deleted,
        "wal_missing_folder": wal_missing_folder,
        "wal_damaged": wal_damaged,
        "table_flush": table_flush,
        "varint_decode": varint_decode,
        "varint_errors": varint_errors,
        "handle_roundtrip": handle_roundtrip,
        "footer_roundtrip": footer_roundtrip,
        "memtable_empty": memtable_empty,
        "config_values": config_values,
        "value_preview": lambda s, d: log(s, d).select("seq", fn.preview("value", 12).alias("preview")),
        "is_tombstone": lambda s, d: log(s, d).select("seq", fn.is_tombstone().alias("deleted")),
        "memtable_snapshot": lambda s, d: text(op.snapshot(log(s, d)), *FULL),
        "memtable_get": lambda s, d: text(op.get(log(s, d), b"user:000042"), *FULL),
        "memtable_size": lambda s, d: op.memtable_size(log(s, d)),
        "size_trajectory": lambda s, d: op.size_trajectory(log(s, d)).select("seq", "memtable_bytes"),
        "flush_point": lambda s, d: op.flush_points(log(s, d), 4096),
        "entry_order": lambda s, d: text(op.entry_order(log(s, d)), "position", "key", "seq"),
        "entry_dedup": entry_dedup,
        "entry_sizes": sizes,
        "tag_profile": tag_profile,
        "varint_encode": varints,
        "range_scan": lambda s, d: text(op.range_scan(log(s, d), b"user:000040", b"user:000060"), *FULL),
        "tiered_read": tiered_read,
        "compact_bottom": lambda s, d: text(op.compact(log(s, d), bottom=True), *FULL),
        "compact_upper": lambda s, d: text(op.compact(log(s, d), bottom=False), *FULL),
        "live_at": lambda s, d: text(op.live_at(log(s, d), NOW), *FULL),
        "as_of_seq": lambda s, d: text(op.as_of_seq(log(s, d), 4000), *FULL),
    }


def oracle_sql() -> dict[str, str]:
    full = "key, seq, tag, value, expire_at"
    return {
        "wal_recover": f"{CTE} SELECT {full} FROM l WHERE seq >= 2500",
        "wal_recover_ordered": f"{CTE} SELECT {full} FROM l WHERE seq >= 9000 ORDER BY seq",
        "wal_recover_summary": f"{CTE} SELECT count(*) AS entries, coalesce(max(seq), 0) AS max_seq FROM l WHERE seq >= 2500",
        "wal_recover_summary_empty": f"{CTE} SELECT count(*) AS entries, coalesce(max(seq), 0) AS max_seq FROM l WHERE seq >= 1099511627776",
        "wal_file_stats": f"{CTE} SELECT file_id, count(*) AS entries, CAST(sum(29 + strlen(key) + {SERIALIZED}) AS BIGINT) AS bytes FROM l GROUP BY file_id",
        "wal_roundtrip": f"{CTE} SELECT {full} FROM l",
        "wal_crc": f"{CTE}{CRC} SELECT seq, crc, printf('%08x', crc) || body AS record FROM c",
        "wal_file_deleted": f"{CTE} SELECT {full}, file_id FROM l WHERE file_id = 2",
        "wal_missing_folder": "SELECT 'LogReadError' AS error",
        "wal_damaged": f"{CTE} SELECT seq AS n, [NULL, 'ChecksumMismatch', 'TruncatedRecord', 'TruncatedRecord', NULL, 'InvalidTag', 'PayloadTooLarge', 'CorruptRecord'][seq % 8 + 1] AS error, CASE WHEN seq % 8 = 0 THEN key END AS key FROM l",
        "table_flush": f"{CTE} SELECT {full} FROM n",
        "varint_decode": f"{CTE} SELECT seq, seq * seq * seq AS number, length({varint_sql('(seq * seq * seq)')}) // 2 AS length FROM l",
        "varint_errors": f"{CTE} SELECT seq, ['empty', 'incomplete', 'incomplete', 'too long'][seq % 4 + 1] AS error, CAST(NULL AS BIGINT) AS number FROM l",
        "handle_roundtrip": f"{CTE} SELECT seq, seq AS offset, seq * seq AS size, length({varint_sql('seq')} || {varint_sql('(seq * seq)')}) // 2 AS length FROM l",
        "footer_roundtrip": f"""{CTE}, f AS (SELECT seq, rpad({varint_sql('seq')} || {varint_sql('(seq * 3)')} || {varint_sql('(seq * seq)')} || '07', 80, '0') || '{MAGIC:016x}' AS f FROM l),
g AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN substr(f, 1, 94) || '00' ELSE f END AS f FROM f)
SELECT seq, CASE WHEN seq % 7 = 0 THEN substr(f, 3) ELSE f END AS footer, CASE WHEN seq % 7 <> 0 THEN seq * 3 END AS meta_size, CASE WHEN seq % 7 <> 0 THEN seq * seq END AS index_offset, CASE WHEN seq % 7 <> 0 THEN seq % 5 <> 0 END AS valid_magic, CASE WHEN seq % 7 = 0 THEN 'TableCorrupted' END AS error FROM g""",
        "memtable_empty": "SELECT CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS entries, CAST(0 AS BIGINT) AS max_seq",
        "config_values": "SELECT * FROM (VALUES ('file', '127.0.0.1 5100 12'), ('override', '127.0.0.1 6200 12'), ('host name', 'ConfigError'), ('port', 'ConfigError'), ('size', 'ConfigError'), ('no number', 'ConfigError'), ('no file', 'ConfigError')) v(name, outcome)",
        "value_preview": f"{CTE} SELECT seq, CASE WHEN strlen(value) > 12 THEN substr(value, 1, 12) || '... (' || strlen(value) || ' bytes)' ELSE value END AS preview FROM l",
        "is_tombstone": f"{CTE} SELECT seq, tag = 1 AS deleted FROM l",
        "memtable_snapshot": f"{CTE} SELECT {full} FROM n ORDER BY key",
        "memtable_get": f"{CTE} SELECT {full} FROM n WHERE key = 'user:000042'",
        "memtable_size": f"{CTE} SELECT CAST(coalesce(sum(strlen(key) + {SERIALIZED} + 16), 0) AS BIGINT) AS bytes FROM n",
        "size_trajectory": f"{CTE}, c AS (SELECT seq, coalesce(x - lag(x) OVER (PARTITION BY key ORDER BY seq), strlen(key) + x + 16) AS d FROM (SELECT *, {SERIALIZED} AS x FROM l)) SELECT seq, CAST(sum(d) OVER (ORDER BY seq) AS BIGINT) AS memtable_bytes FROM c",
        "flush_point": f"{CTE}, c AS (SELECT seq, coalesce(x - lag(x) OVER (PARTITION BY key ORDER BY seq), strlen(key) + x + 16) AS d FROM (SELECT *, {SERIALIZED} AS x FROM l)), t AS (SELECT seq, CAST(sum(d) OVER (ORDER BY seq) AS BIGINT) AS memtable_bytes FROM c) SELECT seq, memtable_bytes FROM t WHERE memtable_bytes >= 4096 ORDER BY seq LIMIT 1",
        "entry_order": f"{CTE} SELECT row_number() OVER (ORDER BY key, seq DESC) AS position, key, seq FROM l",
        "entry_dedup": f"{CTE} SELECT count(*) AS entries FROM (SELECT DISTINCT key, seq FROM l)",
        "entry_sizes": f"{CTE} SELECT seq, CAST(strlen(key) + {SERIALIZED} + 8 AS BIGINT) AS estimated_size, CAST(strlen(key) + {SERIALIZED} + 16 AS BIGINT) AS slot_size, CAST(29 + strlen(key) + {SERIALIZED} AS BIGINT) AS record_len FROM l",
        "tag_profile": f"{CTE} SELECT tag, count(*) AS entries, CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) AS data_bytes, CAST(sum(CASE WHEN tag = 2 THEN 8 ELSE 0 END) AS BIGINT) AS meta_bytes FROM l GROUP BY tag",
        "varint_encode": f"{CTE}, v AS (SELECT seq, seq * seq * seq AS x FROM l), s AS (SELECT seq, x, CAST(greatest(1, ceil(length(ltrim(bin(x), '0')) / 7.0)) AS BIGINT) AS size FROM v) SELECT seq, array_to_string([printf('%02x', ((x >> (7 * i)) & 127) + CASE WHEN i < size - 1 THEN 128 ELSE 0 END) for i in range(size)], '') AS encoded, size FROM s",
        "range_scan": f"{CTE} SELECT {full} FROM n WHERE key >= 'user:000040' AND key < 'user:000060' ORDER BY key",
        "tiered_read": f"{CTE} SELECT key, seq, tag, value, CAST(CASE WHEN seq >= 9800 THEN 0 WHEN seq >= 9000 THEN 1 ELSE 2 END AS INTEGER) AS tier FROM n",
        "compact_bottom": f"{CTE} SELECT {full} FROM n WHERE tag <> 1",
        "compact_upper": f"{CTE} SELECT {full} FROM n",
        "live_at": f"{CTE} SELECT {full} FROM n WHERE tag <> 1 AND (tag <> 2 OR expire_at > {NOW})",
        "as_of_seq": f"{CTE} SELECT {full} FROM (SELECT * FROM l WHERE seq <= 4000) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1",
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys with their newest values, in key order."""
    return text(op.live_at(log_view(spark, sf_dir), NOW).orderBy("key"), *FULL)
