"""Event topics as a segment log, with a Spark data source of their own for batch and stream.

A topic is a folder of Parquet segments. A segment belongs to one partition and holds consecutive offsets; its file name says
which, and the span of its record times, so that the listing of the folder is the offset index and the time index in one: a
replay opens only the segments that meet its window, a stream only those behind its offsets. Segments are never changed.

Reading starts from the earliest offset, or from the offsets that a consumer group has committed. Every segment is read by a
task of its own; of more than ``ALONE`` segments, consecutive ones of a partition share a task up to ``TASK_ROWS`` records."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from inkfold.operators.ordered import running_count

FORMAT = "inkfold_topic"
SCHEMA = "partition INT, offset BIGINT, ts TIMESTAMP, key STRING, value STRING"
ARROW = pa.schema([
    ("partition", pa.int32()), ("offset", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("key", pa.string()), ("value", pa.string()),
])
PARTITIONS = 8
SEGMENT_ROWS = 50_000
ALONE, TASK_ROWS = 256, 50_000
_NAME = re.compile(r"p(\d+)-o(\d+)-n(\d+)-t(-?\d+)_(-?\d+)\.parquet\Z")


@dataclass(frozen=True)
class Segment(InputPartition):
    """Offsets ``first`` to ``last`` (exclusive) of a partition, records between two times (microseconds); ``low`` and ``high``
    bound the offsets, ``since`` and ``until`` the times that are wanted of it."""

    path: str
    partition: int
    first: int
    last: int
    oldest: int
    newest: int
    low: int = 0
    high: int = 1 << 62
    since: int | None = None
    until: int | None = None


@dataclass(frozen=True)
class Run(InputPartition):
    """Segments that one task reads."""

    segments: tuple[Segment, ...]


def runs(found: list[Segment], task_rows: int = TASK_ROWS) -> list[Run]:
    """What the tasks read: a segment each, or, of many, consecutive ones of a partition of up to ``task_rows`` records together."""
    if len(found) <= ALONE:
        return [Run((s,)) for s in found]
    out: list[list[Segment]] = []
    rows = 0
    for s in found:
        n = s.last - s.first
        if not out or out[-1][-1].partition != s.partition or rows + n > task_rows:
            out.append([])
            rows = 0
        out[-1].append(s)
        rows += n
    return [Run(tuple(run)) for run in out]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def segments(path: str, since: int | None = None, until: int | None = None) -> list[Segment]:
    """The segments of a topic that may hold records in [since, until), by their names alone."""
    fs, root = _store(path)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        match = _NAME.match(info.base_name)
        if match:
            partition, first, n, oldest, newest = map(int, match.groups())
            if (since is None or newest >= since) and (until is None or oldest < until):
                found.append(Segment(f"{path.rstrip('/')}/{info.base_name}", partition, first, first + n, oldest, newest, since=since, until=until))
    return sorted(found, key=lambda s: (s.partition, s.first))


def ends(path: str) -> dict[int, int]:
    """The offset behind the last record of each partition."""
    out: dict[int, int] = {}
    for s in segments(path):
        out[s.partition] = max(out.get(s.partition, 0), s.last)
    return out


def append_topic(
    records: DataFrame, path: str, partitions: int = PARTITIONS, segment_rows: int = SEGMENT_ROWS
) -> None:
    """Append ``records(key, ts, value)`` to a topic. Records of one key go to one partition, in order of time within this call; one
    without a key goes by its value. One writer at a time; a repeated task writes the same segment again."""
    _store(path)[0].create_dir(_store(path)[1], recursive=True)
    start = ends(path)
    begins = F.element_at(F.create_map(*[F.lit(x) for p in range(partitions) for x in (p, start.get(p, 0))]), F.col("partition"))
    placed = records.select(
        F.pmod(F.xxhash64(F.coalesce("key", "value")), F.lit(partitions)).cast("int").alias("partition"),
        F.coalesce("ts", F.timestamp_seconds(F.lit(0))).alias("ts"), F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"), F.xxhash64("key", "value").alias("mark"),
    )
    numbered = running_count(placed, ["partition"], "ts", "nth", ["mark"])
    cut = numbered.select(
        "partition", F.floor((F.col("nth") - 1) / segment_rows).alias("segment"), (begins + F.col("nth") - 1).alias("offset"), "ts", "key", "value"
    )

    def write(rows: pa.Table) -> pa.Table:
        batch = rows.sort_by("offset").select(ARROW.names).cast(ARROW)
        times = batch["ts"].cast(pa.int64())
        name = f"p{batch['partition'][0]}-o{batch['offset'][0]}-n{len(batch)}-t{pc.min(times)}_{pc.max(times)}.parquet"
        fs, root = _store(path)
        # A name appears with its whole content only.
        hidden = f"{root}/.{name}.{uuid.uuid4().hex}"
        pq.write_table(batch, hidden, filesystem=fs)
        fs.move(hidden, f"{root}/{name}")
        return pa.table({"name": [name]})

    cut.groupBy("partition", "segment").applyInArrow(write, "name STRING").write.format("noop").mode("overwrite").save()


def _run_records(run: Run) -> Iterator[pa.RecordBatch]:
    for s in run.segments:
        yield from _records(s)


def _records(s: Segment) -> Iterator[pa.RecordBatch]:
    fs, file = _store(s.path)
    with fs.open_input_file(file) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=5000):
            batch = batch.select(ARROW.names).cast(ARROW)
            wanted = pc.and_(pc.greater_equal(batch["offset"], s.low), pc.less(batch["offset"], s.high))
            us = batch["ts"].cast(pa.int64())
            for bound, keep in ((s.since, pc.greater_equal), (s.until, pc.less)):
                if bound is not None:
                    wanted = pc.and_(wanted, keep(us, bound))
            batch = batch.filter(wanted)
            if batch.num_rows:
                yield batch


class TopicReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.since, self.until = (int(options[k]) if k in options else None for k in ("since", "until"))

    def partitions(self) -> list[Run]:
        return runs(segments(self.path, self.since, self.until))

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        # Without any segment Spark asks for one partition that is none.
        return _run_records(partition) if isinstance(partition, Run) else iter(())


class TopicStreamReader(DataSourceStreamReader):
    """Offsets are the next ones to read, per partition."""

    def __init__(self, options: dict):
        self.path, self.group = options["path"], options.get("group")

    def _group_file(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = _store(self.path)
        return fs, f"{root}/_groups", f"{root}/_groups/{self.group}.json"

    def initialOffset(self) -> dict:
        if self.group:
            fs, _, file = self._group_file()
            if fs.get_file_info(file).type != pafs.FileType.NotFound:
                with fs.open_input_file(file) as f:
                    return json.loads(f.read())
        return {}

    def latestOffset(self) -> dict:
        return {str(p): end for p, end in sorted(ends(self.path).items())}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        out = []
        for s in segments(self.path):
            low, high = start.get(str(s.partition), 0), end.get(str(s.partition), 0)
            if s.first < high and s.last > low:
                out.append(Segment(s.path, s.partition, s.first, s.last, s.oldest, s.newest, low, high))
        return runs(out)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return _run_records(partition)

    def commit(self, end: dict) -> None:
        if self.group:
            fs, folder, file = self._group_file()
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(file + ".new") as f:
                f.write(json.dumps(end).encode())
            fs.move(file + ".new", file)


class TopicSource(DataSource):
    """Options: ``path``; for a batch ``since`` and ``until`` (microseconds, until exclusive); for a stream ``group``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TopicReader:
        return TopicReader(self.options)

    def streamReader(self, schema) -> TopicStreamReader:
        return TopicStreamReader(self.options)


def read_topic(
    spark: SparkSession, path: str, since: int | None = None, until: int | None = None, streaming: bool = False, group: str | None = None
) -> DataFrame:
    """The records of a topic: all, those in [since, until) (microseconds; whole segments outside are not opened), or as a stream from
    the earliest offset or from where ``group`` committed."""
    spark.dataSource.register(TopicSource)
    reader = (spark.readStream if streaming else spark.read).format(FORMAT).option("path", path)
    for key, value in (("since", since), ("until", until), ("group", group)):
        if value is not None:
            reader = reader.option(key, value)
    return reader.load()
