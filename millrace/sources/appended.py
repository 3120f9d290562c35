"""Logs that grow: a stream of the lines appended to files, and a sink whose batches count once however often they are run."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file that one task reads, and that are looked at together.
PART_BYTES, LOOK_BYTES = 64 << 20, 1 << 16


def opened(path: str):
    """The store that a URI names (as file, hdfs or s3), or the local one, which all executors mount then; and the path in it."""
    from pyarrow import fs

    # Hadoop writes local URIs with a single slash
    own = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path
    return fs.FileSystem.from_uri(own) if "://" in own else (fs.LocalFileSystem(), own)


def line_end(f, begin: int, end: int, size: int) -> int:
    """The end of the last whole line in bytes ``begin`` to ``end``; of the first one if that is longer; ``begin`` if none is whole by ``size``."""
    hi = end
    while hi > begin:
        lo = max(begin, hi - LOOK_BYTES)
        f.seek(lo)
        if (at := f.read(hi - lo).rfind(b"\n")) >= 0:
            return lo + at + 1
        hi = lo
    while end < size:
        f.seek(end)
        seen = f.read(min(LOOK_BYTES, size - end))
        if (at := seen.find(b"\n")) >= 0:
            return end + at + 1
        end += len(seen)
    return begin


class _Range(InputPartition):
    """Bytes of a file: the lines that begin in them."""

    def __init__(self, file: str, first: int, begin: int, end: int, last: int):
        self.file, self.first, self.begin, self.end, self.last = file, first, begin, end, last


class _Appended(DataSourceStreamReader):
    """Offsets are the bytes read of each file. Where the last trigger ended is known from the first call of a query: it asks for the
    initial offset, or, going on from a checkpoint, for its last batch."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.most = int(options.get("maxbytespertrigger", 0)) or None
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, folder = opened(self.path)
        files = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not i.base_name.startswith((".", "_")))
        out, left = dict(self.at or {}), self.most
        # files that have been read less come first, so that none waits for ever behind one that grows
        for path, size in sorted(files, key=lambda x: (out.get(x[0], 0), x[0])):
            begin = out.get(path, 0)
            if size < begin:
                raise ValueError(f"{path} is shorter than what was read of it")
            if size == begin or left is not None and left <= 0:
                continue
            with store.open_input_file(path) as f:
                end = line_end(f, begin, size if left is None else min(size, begin + left), size)
            if end > begin:
                out[path] = end
                left = None if left is None else left - (end - begin)
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        if self.at is None:
            self.at = dict(end)
        out = []
        for path, last in sorted(end.items()):
            first = start.get(path, 0)
            out += [_Range(path, first, a, min(a + PART_BYTES, last), last) for a in range(first, last, PART_BYTES)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        names = ["file", "at", "value"]

        def batch(lines: list[bytes], begin: int) -> pa.RecordBatch:
            at = [begin]
            for line in lines[:-1]:
                at.append(at[-1] + len(line) + 1)
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines)), pa.array(at, pa.int64()), pa.array([line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines])], names)

        with store.open_input_file(partition.file) as f:
            at, rest = partition.begin, b""
            if at > partition.first:  # a line that begins before is another task's
                f.seek(at - 1)
                while b"\n" not in (seen := f.read(LOOK_BYTES)):
                    at += len(seen)
                at += seen.index(b"\n")
            f.seek(at)
            while at < partition.end or rest:
                seen = f.read(min(LOOK_BYTES, partition.last - at - len(rest)))
                *lines, rest = (rest + seen).split(b"\n")
                # the last of the lines that begin before the end
                begins, take = at, 0
                while take < len(lines) and begins < partition.end:
                    begins += len(lines[take]) + 1
                    take += 1
                if take:
                    yield batch(lines[:take], at)
                if take < len(lines) or not seen:
                    return
                at = begins
                if at >= partition.end:
                    return


class AppendedLines(DataSource):
    """Format appended_lines, a stream: (file, at, value) for every line of the files under a folder, once it has its end; at is its first byte.

    Options: path; suffix of the files' names; maxBytesPerTrigger, which whole lines may pass by one line, over all files together. Lines appended
    between triggers are read once each, over restarts from a checkpoint, too. Files only grow: one that has become shorter is an error. Names that begin with . or _ are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema: StructType) -> _Appended:
        return _Appended({k.lower(): v for k, v in self.options.items()})


def tail_lines(spark: SparkSession, path: str, suffix: str = "", most_bytes: int | None = None) -> DataFrame:
    """A stream of the lines that are appended to the files under ``path``: see AppendedLines."""
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream.format("appended_lines").option("path", path).option("suffix", suffix)
    return (reader if most_bytes is None else reader.option("maxBytesPerTrigger", most_bytes)).load()


def tail_json(spark: SparkSession, path: str, schema: str, suffix: str = "", most_bytes: int | None = None) -> DataFrame:
    """A stream of the rows appended to JSON logs under ``path``; blank lines go, a line that is no JSON is an error."""
    lines = tail_lines(spark, path, suffix, most_bytes).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def drain(query) -> None:
    """Wait until a running query has found twice in a row that nothing more has come."""
    idle = 0
    while idle < 2:
        query.processAllAvailable()
        idle = idle + 1 if query.status["message"].startswith("Waiting for data") else 0
        time.sleep(0.2)


class _Written(WriterCommitMessage):
    def __init__(self, file: str, rows: int):
        self.file, self.rows = file, rows


class _Lines:
    """Writes a task's lines to a file of its own; a batch counts by an entry in the log, made once all its files are there."""

    def __init__(self, path: str):
        self.path = path

    def put(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = opened(self.path)
        store.create_dir(f"{folder}/data", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{folder}/data/{name}", compression=None) as f:
            for batch in iterator:
                rows += batch.num_rows
                f.write("".join(f"{v}\n" for v in batch.column("value").to_pylist()).encode())
        if rows:
            return _Written(name, rows)
        store.delete_file(f"{folder}/data/{name}")
        return _Written("", 0)

    def drop(self, messages) -> None:
        store, folder = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{folder}/data/{m.file}")

    def enter(self, batch: str, messages) -> None:
        from pyarrow import fs

        store, folder = opened(self.path)
        entry = f"{folder}/log/{batch}.json"
        if store.get_file_info(entry).type == fs.FileType.File:
            self.drop(messages)  # the batch was written before: what came now goes
            return
        store.create_dir(f"{folder}/log", recursive=True)
        kept = [m for m in messages if m is not None and m.file]
        line = json.dumps({"batch": batch, "files": [m.file for m in kept], "rows": sum(m.rows for m in kept)})
        # names that begin with _ are not read: the entry is there whole or not at all
        with store.open_output_stream(f"{folder}/log/_{batch}", compression=None) as f:
            f.write(f"{line}\n".encode())
        store.move(f"{folder}/log/_{batch}", entry)


class _StreamLines(DataSourceStreamArrowWriter):
    def __init__(self, path: str, writer: str):
        self.lines, self.writer = _Lines(path), writer

    def write(self, iterator):
        return self.lines.put(iterator)

    def commit(self, messages, batchId):
        self.lines.enter(f"{self.writer}-{batchId:012d}", messages)

    def abort(self, messages, batchId):
        self.lines.drop(messages)


class _BatchLines(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.lines, self.batch = _Lines(path), batch

    def write(self, iterator):
        return self.lines.put(iterator)

    def commit(self, messages):
        self.lines.enter(self.batch, messages)

    def abort(self, messages):
        self.lines.drop(messages)


class LinesOnce(DataSource):
    """Format lines_once, a sink of one string column ``value``: appends lines to a folder, each batch once.

    Options: path; of a stream, writer: a name that is its own among those that write to the folder; of a table, batch: a
    name for what is written. A batch whose name is in the log already leaves nothing, as when a run is repeated after a failure. Files of tasks that failed are never read.
    """

    @classmethod
    def name(cls) -> str:
        return "lines_once"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamLines:
        return _StreamLines(self.options["path"], self.options.get("writer", "stream"))

    def writer(self, schema: StructType, overwrite: bool) -> _BatchLines:
        if not (batch := self.options.get("batch")):
            raise ValueError("name the batch: option batch")
        return _BatchLines(self.options["path"], batch)


def _as_lines(df: DataFrame) -> DataFrame:
    df.sparkSession.dataSource.register(LinesOnce)
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def append_once(df: DataFrame, path: str, batch: str) -> None:
    """Append rows as JSON lines under the name ``batch``; if that was done before, nothing changes."""
    _as_lines(df).write.format("lines_once").mode("append").option("path", path).option("batch", batch).save()


def append_stream(stream: DataFrame, path: str, writer: str = "stream"):
    """A stream writer that appends rows as JSON lines, each micro-batch once; it needs a checkpointLocation and a trigger."""
    return _as_lines(stream).writeStream.format("lines_once").option("path", path).option("writer", writer)


def read_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was appended, with its batch: rows of files that a log entry names. No rows where nothing was appended."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"batch string, {schema}")
    log = spark.read.schema("batch string, files array<string>, rows long").json(f"{path}/log").select("batch", F.explode("files").alias("file"))
    lines = spark.read.text(f"{path}/data").select("value", F.col("_metadata.file_name").alias("file"))
    return lines.join(log, "file").select("batch", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("batch", "row.*")
