"""Helpers of the keyed stateful streams: event-time timers on the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None):
    """Streams started inside keep their state in RocksDB, which timers and list state need, in ``partitions`` state partitions
    (default: the session's shuffle partitions). Both go into a stream's checkpoint and hold for its life; other streams of the
    session keep theirs."""
    wanted = {PROVIDER: ROCKSDB} | ({} if partitions is None else {PARTITIONS: str(partitions)})
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def with_state(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """Run ``processor`` per key. ``df`` comes from a frame with a watermark but has no event-time column of its own any more (only
    whole microseconds), so Spark drops no late row unseen: the processor compares each with the watermark and reports it."""
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


def passed_us(timers) -> int:
    """The watermark in microseconds: rows up to it have all been seen, later arrivals of such times are late."""
    return max(timers.getCurrentWatermarkInMs(), 0) * 1000


def next_timer(us: int) -> int:
    """The first millisecond at which the watermark has passed ``us``."""
    return us // 1000 + 1


def packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    """Rows as one element of a list state: the state store is asked once for all of them, not once a row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows, schema=schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(elements: Iterator[tuple[bytes]], schema: pa.Schema) -> pd.DataFrame:
    """The rows of all elements of a list state, whole numbers as such also among nulls."""
    tables = [pa.ipc.open_stream(element).read_all() for (element,) in elements]
    whole = {pa.int64(): pd.Int64Dtype()}.get
    return (pa.concat_tables(tables) if tables else schema.empty_table()).to_pandas(types_mapper=whole)
