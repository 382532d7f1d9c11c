"""The log's row schema and record tags."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, ByteType, DecimalType, LongType, StructField, StructType

#: Record tags (fixed values of the record format).
NORMAL, TOMBSTONE, EXPIRING = 0, 1, 2
TAGS = (NORMAL, TOMBSTONE, EXPIRING)

#: One versioned record. ``value`` is null for tombstones only (an empty value is zero bytes), ``expire_at`` (Unix seconds) is set for expiring records only.
ENTRY_SCHEMA = StructType(
    [
        StructField("key", BinaryType(), False),
        StructField("seq", LongType(), False),
        StructField("tag", ByteType(), False),
        StructField("value", BinaryType(), True),
        StructField("expire_at", LongType(), True),
    ]
)

#: A record with its place: file id and record number in the file, which order versions of one sequence number.
LOG_SCHEMA = StructType([*ENTRY_SCHEMA.fields, StructField("file_id", LongType(), False), StructField("ord", LongType(), False)])

#: Unsigned 64-bit numbers that may exceed BIGINT.
U64 = DecimalType(20, 0)
HANDLE_SCHEMA = StructType([StructField("offset", U64, False), StructField("size", U64, False)])
