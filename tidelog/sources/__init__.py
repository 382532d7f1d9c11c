"""The ``kvwal`` data source: log files as a batch source, a sink and a stream.

Files are named NNNNNNNNN.wal; anything else in the folder is ignored. A file can't be split (it has no sync marks), so
there is one partition a file: land a log in Parquet before reading it repeatedly.
"""

from __future__ import annotations

import io
import logging
import os
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tidelog import config
from tidelog import functions as fn
from tidelog.codec import Entry, Footer, encode_record, read_record
from tidelog.errors import LogReadError, LogWriteError, TidelogError, TruncatedRecord
from tidelog.schema import LOG_SCHEMA, U64

SUFFIX = ".wal"
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20
ARROW = pa.schema([("key", pa.binary()), ("seq", pa.int64()), ("tag", pa.int8()), ("value", pa.binary()), ("expire_at", pa.int64()), ("file_id", pa.int64()), ("ord", pa.int64())])


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and place of a path or URI."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def file_name(file_id: int) -> str:
    return f"{file_id:09d}{SUFFIX}"


def log_files(folder: str) -> list[tuple[int, str]]:
    """(file id, path) of a folder's log files, by id, then by path."""
    try:
        store, at = open_folder(folder)
        infos = store.get_file_info(fs.FileSelector(at))
    except (OSError, pa.ArrowException) as e:
        raise LogReadError(f"can't list the folder: {e}", folder) from e
    found = []
    for info in infos:
        stem = info.base_name.removesuffix(SUFFIX)
        digits = stem.removeprefix("+")
        if info.type == fs.FileType.File and info.base_name.endswith(SUFFIX) and digits.isascii() and digits.isdigit() and int(digits) < 1 << 64:
            found.append((int(digits), info.path))
    return sorted(found)


def delete_file(folder: str, file_id: int) -> None:
    """Remove a log file; an error if there is none."""
    store, at = open_folder(folder)
    path = f"{at}/{file_name(file_id)}"
    try:
        if store.get_file_info(path).type != fs.FileType.File:
            raise LogReadError("no such file", path)
        store.delete_file(path)
    except OSError as e:
        raise LogReadError(f"can't delete: {e}", path) from e


@dataclass
class LogFile(InputPartition):
    folder: str
    path: str
    file_id: int
    may_end_early: bool
    min_seq: int | None = None


def read_batches(part: LogFile) -> Iterator[pa.RecordBatch]:
    """A file's records from ``min_seq`` on. A cut last record ends the file quietly where that is allowed; anything else wrong raises."""
    store, _ = open_folder(part.folder)
    columns: list[list] = [[] for _ in ARROW]
    size = 0
    with store.open_input_stream(part.path) as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        place = 0
        while True:
            try:
                entry = read_record(stream, part.path)
            except TruncatedRecord:
                if not part.may_end_early:
                    raise
                entry = None
            if entry is None:
                break
            if part.min_seq is None or entry.seq >= part.min_seq:
                for column, x in zip(columns, (entry.key, entry.seq, entry.tag, entry.value, entry.expire_at, part.file_id, place), strict=True):
                    column.append(x)
                size += len(entry.key) + len(entry.value or b"")
            place += 1
            if len(columns[0]) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)
                columns, size = [[] for _ in ARROW], 0
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.strict = options["path"], options.get("strict", "false").lower() == "true"
        self.min_seq: int | None = int(options["min_seq"]) if "min_seq" in options else None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes lower bounds of seq; Spark applies the others."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo) and f.attribute == ("seq",) and isinstance(f.value, int):
                low = f.value + isinstance(f, GreaterThan)
                self.min_seq = low if self.min_seq is None else max(low, self.min_seq)
                if not isinstance(f, EqualTo):
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        files = log_files(self.folder)
        return [LogFile(self.folder, path, file_id, not self.strict or i == len(files) - 1, self.min_seq) for i, (file_id, path) in enumerate(files)] or [LogFile(self.folder, "", -1, True)]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_batches(partition)


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class LogWriter(DataSourceArrowWriter):
    """A new file for each task that has rows. Files appear under their names when all tasks are done.

    Rows are entries, or records that are encoded already (one binary column ``record``, as :func:`write_log` makes it in the JVM).
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        store, at = open_folder(self.folder)
        store.create_dir(at, recursive=True)
        self.old = log_files(self.folder)
        self.first = max((i for i, _ in self.old), default=0) + 1

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = open_folder(self.folder)
        final = f"{at}/{file_name(self.first + task.partitionId())}"
        temporary = f"{final}.{task.taskAttemptId()}.tmp"
        out = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                out = open(temporary, "wb") if isinstance(store, fs.LocalFileSystem) else store.open_output_stream(temporary)
            if "record" in batch.schema.names:
                out.write(b"".join(batch.column("record").to_pylist()))
            else:
                out.write(b"".join(encode_record(Entry(*row)) for row in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "tag", "value", "expire_at")), strict=True)))
        if out is None:
            return Written(None, None)
        out.flush()
        if isinstance(store, fs.LocalFileSystem):
            os.fsync(out.fileno())
        out.close()
        return Written(temporary, final)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """New files have higher numbers than old ones: they are put in place first, and old ones go after that, so that no crash loses a record."""
        store, _ = open_folder(self.folder)
        for m in messages:
            if m is not None and m.temporary:
                if store.get_file_info(m.final).type != fs.FileType.NotFound:
                    raise LogWriteError("the file exists", m.final)
                store.move(m.temporary, m.final)
        if self.overwrite:
            for _, path in self.old:
                store.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = open_folder(self.folder)
        for m in messages:
            if m is not None and m.temporary and store.get_file_info(m.temporary).type != fs.FileType.NotFound:
                store.delete_file(m.temporary)


class LogStream(DataSourceStreamReader):
    """New files in the order of their ids; the offset is the highest id read. A file must be whole when it appears.

    ``min_seq`` and ``strict`` hold as for batches (with ``strict``, no file may end within a record). Files that appear with an id
    at or below the offset are never read; each batch names those of them that came since the last one in the driver's log.
    """

    def __init__(self, options: dict[str, str]):
        self.folder, self.strict = options["path"], options.get("strict", "false").lower() == "true"
        self.min_seq: int | None = int(options["min_seq"]) if "min_seq" in options else None
        self.known: set[int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file_id": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file_id": max((i for i, _ in log_files(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = log_files(self.folder)
        below = {i for i, _ in files if i <= start["file_id"]}
        if self.known is not None and (late := sorted(below - self.known)):
            logging.getLogger(__name__).warning("log files %s of %s came after later ones and are not read", late, self.folder)
        self.known = below | {i for i, _ in files if i <= end["file_id"]}
        return [LogFile(self.folder, path, i, not self.strict, self.min_seq) for i, path in files if start["file_id"] < i <= end["file_id"]]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        yield from read_batches(partition)


class LogSource(DataSource):
    """``spark.read.format("kvwal")``. Options: ``path`` (else the configuration's data_dir); ``min_seq``; ``strict`` (only the newest file may end within a record)."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options if "path" in options else {**options, "path": config.current().storage.data_dir})

    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> StructType:
        return LOG_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LogWriter(self.options, overwrite)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let lower bounds of seq reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)


def write_log(log: DataFrame, folder: str, *, mode: str = "append") -> None:
    """Write a log's entries as log files, one a task. Records are encoded in the JVM; Python workers only write bytes."""
    register(log.sparkSession)
    log.select(fn.encode_record().alias("record")).write.format("kvwal").mode(mode).save(folder)


def decode_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Adds to ``df`` what the record at the beginning of a binary column holds: error (the class of what is wrong, null if nothing is), key, seq, tag, value, expire_at.

    A null or empty record is a clean end: no error and no entry. ``df`` must not have columns of these names.
    """
    columns = df.columns
    fields = [("error", pa.string()), *((f.name, f.type) for f in ARROW if f.name not in ("file_id", "ord"))]

    def run(batches):
        for batch in batches:
            made: list[list] = [[] for _ in fields]
            for data in batch.column(columns.index(record)).to_pylist():
                error, entry = None, None
                try:
                    entry = read_record(io.BytesIO(data or b""))
                except LogReadError as e:
                    error = type(e).__name__
                for c, x in zip(made, (error, *((entry.key, entry.seq, entry.tag, entry.value, entry.expire_at) if entry else [None] * 5)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, (_, t) in zip(made, fields, strict=True))], names=[*columns, *(n for n, _ in fields)])

    added = StructType().add("error", "string").add("key", "binary").add("seq", "long").add("tag", "byte").add("value", "binary").add("expire_at", "long")
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def decode_footers(df: DataFrame, footer: str = "footer") -> DataFrame:
    """Adds to ``df`` what a binary column of table footers holds: meta_offset, meta_size, index_offset, index_size (DECIMAL(20, 0)) and valid_magic, or error (the class of what is wrong). ``df`` must not have columns of these names."""
    columns = df.columns
    names = ["meta_offset", "meta_size", "index_offset", "index_size"]

    def one(data: bytes | None) -> tuple:
        try:
            found = Footer.decode(data or b"")
        except TidelogError as e:
            return (*[None] * 5, type(e).__name__)
        numbers = (found.meta_index.offset, found.meta_index.size, found.index.offset, found.index.size)
        return (*map(Decimal, numbers), found.valid_magic(), None)

    def run(batches):
        for batch in batches:
            rows = [one(x) for x in batch.column(columns.index(footer)).to_pylist()]
            kinds = [*[pa.decimal128(20, 0)] * 4, pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=[*columns, *names, "valid_magic", "error"])

    added = StructType([*(StructField(c, U64) for c in names), StructField("valid_magic", BooleanType()), StructField("error", StringType())])
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))
