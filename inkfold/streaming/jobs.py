"""Streaming jobs. Each start function returns the running query; ``once=True`` processes what is
there and stops (availableNow), otherwise the query keeps running."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkfold.functions.text import py_strip
from inkfold.operators.documents import latest_per_key, reprocess_guard
from inkfold.operators.feedback import usage_kpis
from inkfold.operators.search import chunk_text, encode_texts, with_point_ids
from inkfold.sources.writers import append_version, write_correction_archive
from inkfold.streaming.keyed import next_timer, passed_us, rocksdb, with_state


def _start(
    stream: DataFrame,
    checkpoint: str,
    batch: Callable[[DataFrame, int], None],
    once: bool,
    interval: str,
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def dedup_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event id once. Streams keep ids for the watermark delay only, so state stays bounded."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def kpi_stream(
    events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Usage KPIs over a live stream; rows later than the watermark are dropped."""
    return usage_kpis(events.withWatermark("ts", delay), width, slide)


def attribute_feedback_stream(
    queries: DataFrame, feedback: DataFrame, max_age: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Feedback with the query named by its ``query_id``; unmatched feedback is kept. Both sides'
    state is bounded by the watermarks and the age limit."""
    q = queries.select(
        F.col("event_id").alias("matched_query_id"), F.col("ts").alias("asked_at"), "query_text"
    ).withWatermark("asked_at", delay)
    f = feedback.withWatermark("ts", delay)
    near = (
        (F.col("query_id") == F.col("matched_query_id"))
        & (F.col("ts") >= F.col("asked_at"))
        & (F.col("ts") <= F.col("asked_at") + F.expr(f"INTERVAL {max_age}"))
    )
    return f.join(q, near, "left_outer")


def process_uploads(
    uploads: DataFrame,
    recognise: Callable[[DataFrame], DataFrame],
    documents_path: str,
    dead_letter_path: str,
    checkpoint: str,
    history: Callable[[], tuple[DataFrame, DataFrame, DataFrame]] | None = None,
    once: bool = False,
    interval: str = "30 seconds",
    pages_path: str | None = None,
    regions_path: str | None = None,
) -> StreamingQuery:
    """Upload events -> document versions; records that cannot be used go to a dead-letter table and
    the stream goes on.

    ``recognise`` turns a batch of uploads into document rows (texts, page count, ``updated_at``) or into
    (documents, pages, regions), the latter two with ``updated_at`` and stored under their own paths.
    Each batch only stores its own rows; ``read_versions`` with ``newest_documents`` / ``newest_of`` (pages
    by document, regions by page) resolves them, the newest version winning across batches. ``history``
    returns (pages, regions, corrections); documents with user corrections are then left as they
    are. Redelivered events give the same table."""

    def run(batch: DataFrame, batch_id: int) -> None:
        usable = F.col("event_id").isNotNull() & F.col("doc_number").isNotNull()
        bad = batch.where(~usable).select("raw", F.lit("unusable record").alias("error"))
        bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").json(
            f"{dead_letter_path}/batch={batch_id}"
        )
        newest = latest_per_key(
            batch.where(usable), "doc_number", [F.col("ts").desc_nulls_last(), F.col("event_id")]
        )
        made = recognise(newest)
        rows, pages_rows, regions_rows = made if isinstance(made, tuple) else (made, None, None)
        if history is not None:
            pages, regions, corrections = history()
            keep = reprocess_guard(
                rows.select(F.col("id").alias("document_id")), pages, regions, corrections
            ).where(F.col("action") == "reprocess")
            rows = rows.join(keep.select(F.col("document_id").alias("id")), "id", "left_semi")
            if pages_rows is not None:
                pages_rows = pages_rows.join(keep.select("document_id"), "document_id", "left_semi")
            if regions_rows is not None:
                regions_rows = regions_rows.join(pages_rows.select(F.col("id").alias("page_id")), "page_id", "left_semi")
        for part, path in ((rows, documents_path), (pages_rows, pages_path), (regions_rows, regions_path)):
            if part is not None and path is not None:
                append_version(part.withColumnRenamed("updated_at", "_version"), path, batch_id, F.col("_version"))

    return _start(uploads, checkpoint, run, once, interval)


def index_documents(
    documents: DataFrame,
    make_encoder: Callable,
    chunks_path: str,
    checkpoint: str,
    model_version: str = "retrieval_v1",
    once: bool = False,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Consumed and updated documents ``(document_id, text, ts)`` -> re-encoded chunks. Each batch stores
    its own chunks only; ``read_versions`` with ``newest_of(rows, "document_id")`` gives the table. Of
    several versions the newest counts, in whatever order they come; blank content is skipped."""

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = latest_per_key(
            batch.where(py_strip(F.coalesce("text", F.lit(""))) != ""),
            "document_id",
            [F.col("ts").desc_nulls_last(), F.col("text")],
        )
        dated = chunk_text(newest).join(newest.select("document_id", "ts"), "document_id")
        chunks = encode_texts(with_point_ids(dated), make_encoder).select(
            "id",
            "vector",
            F.col("document_id").cast("string").alias("document_id"),
            F.col("chunk_index").cast("int").alias("chunk_index"),
            "chunk_text",
            F.lit(model_version).alias("model_version"),
            F.col("ts").alias("_version"),
        )
        append_version(chunks, chunks_path, batch_id, F.col("_version"))

    return _start(documents, checkpoint, run, once, interval)


def archive_stream(
    corrections: DataFrame, archive_path: str, checkpoint: str, once: bool = True, interval: str = "15 minutes"
) -> StreamingQuery:
    """Incremental correction archive; ids already archived are not written again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write_correction_archive(batch.dropDuplicates(["correction_id"]), archive_path)

    return _start(corrections, checkpoint, run, once, interval)


class AlertStates(StatefulProcessor):
    """State per series: start of the breach, shown state, and samples that wait for the watermark."""

    STATES = np.array(["inactive", "pending", "firing"], dtype=object)
    SLICE = 1 << 16

    def __init__(self, hold_us: int):
        self.hold_us = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "since BIGINT, state STRING")
        # Time and breach of a sample in one number, which sorts by time and then lets the unbreached come first; an element of the
        # list holds up to ``SLICE`` of them.
        self.waiting = handle.getListState("waiting", "packed BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = passed_us(timerValues), None
        for got in rows:
            us = got["us"].to_numpy(dtype=np.int64)
            late = (us <= passed) & (passed > 0)
            if late.any():
                yield self._rows(key, us[late], None, None, True)
            us, on = us[~late], got["breached"].to_numpy(dtype=bool)[~late]
            if len(us):
                for element in self._elements(us * 2 + on):
                    self.waiting.appendValue(element)
                first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is not None:
            self.handle.registerTimer(next_timer(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = passed_us(timerValues)
        packed = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, np.int64) for (p,) in self.waiting.get())]))
        ready = int(np.searchsorted(packed, 2 * (passed + 1)))
        us, on, rest = packed[:ready] >> 1, (packed[:ready] & 1).astype(bool), packed[ready:]
        if len(us):
            since, shown = self.shown.get() if self.shown.exists() else (-1, "inactive")
            opens = on & ~np.concatenate([[since >= 0], on[:-1]])
            starts = np.maximum.accumulate(np.where(opens, us, since))
            now = np.where(on, 1 + (us - starts >= self.hold_us), 0).astype(np.int8)
            before = np.concatenate([np.flatnonzero(self.STATES == shown), now[:-1]])
            turned = np.flatnonzero(now != before)
            # A series at rest keeps no state.
            if on[-1]:
                self.shown.update((int(starts[-1]), self.STATES[now[-1]]))
            else:
                self.shown.clear()
            for start in range(0, len(turned), self.SLICE):
                part = turned[start : start + self.SLICE]
                yield self._rows(key, us[part], self.STATES[before[part]], self.STATES[now[part]], False)
            if len(rest):
                self.waiting.put(self._elements(rest))
            else:
                self.waiting.clear()
        if len(rest):
            self.handle.registerTimer(next_timer(int(rest[0] >> 1)))

    def _elements(self, packed: np.ndarray) -> list[tuple[bytes]]:
        return [(packed[i : i + self.SLICE].tobytes(),) for i in range(0, len(packed), self.SLICE)]

    @staticmethod
    def _rows(key, us: np.ndarray, before, now, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"series": key[0], "us": us, "from_state": before, "to_state": now, "late": late})

    def close(self) -> None:
        pass


def alert_changes(samples: DataFrame, hold_seconds: int, delay: str = "1 minute") -> DataFrame:
    """State changes of an alert per series, and late samples. ``samples(series, ts, breached)``; rows
    ``(series, ts, from_state, to_state, late)``, a late sample with null states.

    Samples wait in keyed state until the watermark (newest time seen, less ``delay``) has passed them and are then
    taken in time order, in whatever order and batches they came; a timer does so for series that fall silent. Of samples of one
    instant the unbreached come first. Those that come after the watermark has passed their time are late. A series at rest,
    with nothing waiting, keeps no state. Start the stream inside ``keyed.rocksdb``."""
    timed = samples.withWatermark("ts", delay).select(
        "series", F.unix_micros("ts").alias("us"), F.coalesce("breached", F.lit(False)).alias("breached")
    )
    schema = "series STRING, us BIGINT, from_state STRING, to_state STRING, late BOOLEAN"
    changes = with_state(timed, ["series"], AlertStates(hold_seconds * 1000000), schema)
    return changes.select("series", F.timestamp_micros("us").alias("ts"), "from_state", "to_state", "late")


def alert_stream(samples: DataFrame, hold_seconds: int, delay: str = "1 minute") -> DataFrame:
    """The state changes of ``alert_changes`` alone; ``write_alerts`` also stores the late samples."""
    return alert_changes(samples, hold_seconds, delay).where(~F.col("late")).drop("late")


def write_alerts(
    samples: DataFrame,
    hold_seconds: int,
    changes_path: str,
    late_path: str,
    checkpoint: str,
    delay: str = "1 minute",
    once: bool = False,
    interval: str = "30 seconds",
    partitions: int | None = None,
) -> StreamingQuery:
    """State changes to one Parquet table, late samples per series and time with their count ``n`` to another, a
    folder per batch each; repeating a batch gives the same tables."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        changes = batch.where(~F.col("late")).drop("late")
        late = batch.where("late").groupBy("series", "ts").agg(F.count("*").alias("n"))
        for part, path in ((changes, changes_path), (late, late_path)):
            part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    with rocksdb(samples.sparkSession, partitions):
        return _start(alert_changes(samples, hold_seconds, delay), checkpoint, run, once, interval)
