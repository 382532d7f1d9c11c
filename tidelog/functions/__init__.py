"""Column expressions of the log: tags, sizes, checksums, binary encodings. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.codec import FOOTER_SIZE, MAGIC, MAGIC_SIZE
from tidelog.schema import EXPIRING, TOMBSTONE

#: Bytes that sizes count for each record besides key and value (fixed values): of an entry, of a table's slot, of a log header.
ENTRY_OVERHEAD, SLOT_OVERHEAD, HEADER_SIZE = 8, 16, 21


def is_tombstone() -> Column:
    return F.col("tag") == TOMBSTONE


def octets(column: str) -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def data_len() -> Column:
    """Bytes of the user's value; none for a tombstone."""
    return F.when(is_tombstone(), F.lit(0).cast("long")).otherwise(octets("value"))


def meta_len() -> Column:
    """Bytes of the expiry."""
    return F.when(F.col("tag") == EXPIRING, 8).otherwise(0).cast("long")


def serialized_len() -> Column:
    return data_len() + meta_len()


def estimated_size() -> Column:
    """Size of an entry on its own."""
    return octets("key") + serialized_len() + F.lit(ENTRY_OVERHEAD).cast("long")


def slot_size() -> Column:
    """Size of an entry in the memory table."""
    return octets("key") + serialized_len() + F.lit(SLOT_OVERHEAD).cast("long")


def payload_len() -> Column:
    """Payload length in a log record: the key length field, the key and the value section."""
    return F.lit(8).cast("long") + octets("key") + serialized_len()


def record_len() -> Column:
    return F.lit(HEADER_SIZE).cast("long") + payload_len()


def big_endian(number: Column, width: int) -> Column:
    """A non-negative number as ``width`` bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * width, "0"))


def record_body() -> Column:
    """A log record's bytes behind the checksum."""
    section = F.when(is_tombstone(), F.unhex(F.lit(""))).when(F.col("tag") == EXPIRING, F.concat(big_endian(F.col("expire_at"), 8), F.col("value"))).otherwise(F.col("value"))
    return F.concat(big_endian(payload_len(), 8), big_endian(F.col("tag"), 1), big_endian(F.col("seq"), 8), big_endian(octets("key"), 8), F.col("key"), section)


def record_crc() -> Column:
    """CRC-32 of a record, as a BIGINT."""
    return F.crc32(record_body())


def encode_record() -> Column:
    """A log record's bytes, equal to those of :func:`tidelog.codec.encode_record`."""
    return F.concat(big_endian(record_crc(), 4), record_body())


def varint_size(number: Column) -> Column:
    """Bytes of a non-negative BIGINT as a varint."""
    return F.when(number == 0, 1).otherwise(F.ceil(F.length(F.bin(number)) / 7.0)).cast("long")


def encode_varint(number: Column) -> Column:
    """A non-negative BIGINT as an unsigned LEB128 varint."""
    size = varint_size(number).cast("int")

    def byte(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", number, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("long"))
        return F.lpad(F.hex(F.when(i < size - 1, low.bitwiseOR(F.lit(128).cast("long"))).otherwise(low)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), ""))


def encode_handle(offset: Column, size: Column) -> Column:
    return F.concat(encode_varint(offset), encode_varint(size))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; without this, expressions within expressions grow with every use.

    Decoders take stored columns: on a column that is computed by lambdas in the same projection Spark's generated code gives nulls.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bytes(data: Column, most: int) -> Column:
    """The first ``most`` bytes as an array of BIGINT; none if null."""

    def split(shown: Column) -> Column:
        places = F.when(F.length(shown) > 0, F.sequence(F.lit(0), F.floor(F.length(shown) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.conv(F.substring(shown, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))

    return _let(F.hex(F.substring(data, 1, most)), split)


def varint(data: Column) -> Column:
    """struct(number, length, error) of the varint at the beginning of a binary column.

    number: DECIMAL(20, 0); overlong forms are accepted, bits above 64 fall away. length: its bytes. error: empty, incomplete (it ends within ten bytes) or
    too long (an eleventh byte follows), null if nothing is wrong; else number and length are null.
    """

    def number(b: Column, n: Column) -> Column:
        parts = F.transform(F.slice(b, F.lit(1), n.cast("int")), lambda x, i: F.when(i == 9, x.bitwiseAND(F.lit(1).cast("long"))).otherwise(x.bitwiseAND(F.lit(127).cast("long"))))
        return F.aggregate(F.reverse(parts), F.lit(0).cast("decimal(20,0)"), lambda total, x: (total * F.lit(128) + x).cast("decimal(20,0)"))

    def found(b: Column, n: Column) -> Column:
        error = F.when(F.size(b) == 0, "empty").when((n == 0) & (F.size(b) > 10), "too long").when(n == 0, "incomplete")
        return F.struct(F.when(n > 0, number(b, n)).alias("number"), F.when(n > 0, n).alias("length"), error.alias("error"))

    last = lambda b: F.array_position(F.transform(F.slice(b, F.lit(1), F.lit(10)), lambda x: x < 128), True)
    return _let(_bytes(data, 11), lambda b: _let(last(b), lambda n: found(b, n)))


def varint_error(data: Column) -> Column:
    return varint(data)["error"]


def varint_length(data: Column) -> Column:
    return varint(data)["length"]


def decode_varint(data: Column) -> Column:
    return varint(data)["number"]


def decode_handle(data: Column) -> Column:
    """struct(offset, size, length) of a block handle at the beginning of a binary column; null where either varint is damaged."""

    def whole(x: Column, y: Column) -> Column:
        return F.when(x["error"].isNull() & y["error"].isNull(), F.struct(x["number"].alias("offset"), y["number"].alias("size"), (x["length"] + y["length"]).alias("length")))

    return _let(varint(data), lambda x: _let(varint(F.substring(data, x["length"].cast("int") + 1, F.lit(10 + 1))), lambda y: whole(x, y)))


def encode_footer(meta_index: Column, index: Column) -> Column:
    """A table footer from two encoded handles: 40 bytes filled with zeros, then the mark."""
    handles = F.hex(F.concat(meta_index, index))
    return F.unhex(F.concat(F.rpad(handles, 2 * (FOOTER_SIZE - MAGIC_SIZE), "0"), F.lit(f"{MAGIC:016x}")))


def preview(column: str, most: int = 64) -> Column:
    """Text of the first bytes of a binary column for display, bad bytes replaced, with the whole length if it was cut."""
    shown = F.make_valid_utf8(F.substring(column, 1, most).cast("string"))
    return F.when(F.octet_length(column) > most, F.concat(shown, F.lit("... ("), F.octet_length(column).cast("string"), F.lit(" bytes)"))).otherwise(shown)
