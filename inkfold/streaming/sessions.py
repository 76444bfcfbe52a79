"""Live attribution of feedback to queries, by query id and by session.

Both inputs are one keyed stream. A key is a bucket of sessions (by hash) in a slice of time, or a bucket of query ids: their number
follows from the buckets and the time that passes, not from the number of sessions and queries, and a key's rows are matched
together. A query goes to the bucket of its id and to that of its session, where it is handed on to the slices in which feedback may still
refer to it. So a session that holds a large share of all rows ('anonymous') is spread over as many keys as it has slices. Feedback
waits at its keys until the watermark has passed it, when all queries before it have been seen, and then takes the newest: the result
does not depend on the order in which rows arrive or on how they are cut into micro-batches. Timers do this, and remove queries that no
feedback can refer to any more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkfold.streaming.keyed import next_timer, packed, passed_us, rocksdb, unpacked, with_state

# ``who`` is the session or the id of the query; a query may go when the watermark is past ``until``.
ASKED = pa.schema([("who", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("until", pa.int64())])
WAITING = pa.schema([("who", pa.string()), ("us", pa.int64()), ("id", pa.int64())])
SCHEMA = "feedback_id BIGINT, us BIGINT, matched_query_id BIGINT, matched_by STRING, late BOOLEAN"
# Buckets of sessions (and of feedback without one) per slice, buckets of query ids, and the length of a slice in ages.
SESSION_BUCKETS, ID_BUCKETS, SLICE_AGES = 4, 16, 4


class NewestQuery(StatefulProcessor):
    """State per key: the queries that may still be referred to, and the feedback that waits for the watermark."""

    def __init__(self, age_us: int, keep_us: int):
        self.age_us, self.keep_us = age_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getListState("asked", "packed BINARY")
        self.waiting = handle.getListState("waiting", "packed BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first, last = passed_us(timerValues), None, None
        for got in rows:
            asked = got["kind"] == "q"
            queries, feedback = got[asked], got[~asked]
            late = feedback["us"] <= passed
            if passed and late.any():
                lost = feedback[late]
                yield pd.DataFrame({"feedback_id": lost["id"], "us": lost["us"], "matched_query_id": None, "matched_by": None, "late": True})
                # A late query can still serve feedback that has not been passed.
                feedback = feedback[~late]
            if len(queries):
                until = np.maximum(queries["us"] + self._kept(key), passed)
                self.asked.appendValue((packed(queries.assign(until=until), ASKED),))
                last = max(int(until.max()), -1 if last is None else last)
            if len(feedback):
                self.waiting.appendValue((packed(feedback, WAITING),))
                first = int(feedback["us"].min()) if first is None else min(first, int(feedback["us"].min()))
        for us in {first, last} - {None}:
            self.handle.registerTimer(next_timer(us))

    def _kept(self, key) -> int:
        return self.keep_us if key[0] == "i" else self.age_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = passed_us(timerValues)
        asked = unpacked(self.asked.get(), ASKED)
        waiting = unpacked(self.waiting.get(), WAITING)
        ready, rest = waiting[waiting["us"] <= passed], waiting[waiting["us"] > passed]
        if len(ready):
            if key[0] == "i":
                good = ready["who"].isin(asked["who"])
                found, by = ready["who"].where(good).astype("Int64"), "query_id"
            else:
                # The newest query up to the feedback; of several at one time, the largest id.
                ready = ready.sort_values("us", kind="stable")
                newest = asked.rename(columns={"id": "query_id"}).sort_values(["us", "query_id"])
                found = pd.merge_asof(ready, newest, on="us", by="who", tolerance=self.age_us)["query_id"].set_axis(ready.index)
                good, by = found.notna(), "session"
            yield pd.DataFrame({
                "feedback_id": ready["id"], "us": ready["us"], "matched_query_id": found, "matched_by": np.where(good, by, None), "late": False,
            })
            self._put(self.waiting, rest, WAITING)
            if len(rest):
                self.handle.registerTimer(next_timer(int(rest["us"].min())))
        kept = asked[asked["until"] >= passed]
        if len(kept) < len(asked):
            self._put(self.asked, kept, ASKED)

    @staticmethod
    def _put(state, rows: pd.DataFrame, schema: pa.Schema) -> None:
        if len(rows):
            state.put([(packed(rows, schema),)])
        else:
            state.clear()

    def close(self) -> None:
        pass


def attribution_candidates(
    queries: DataFrame, feedback: DataFrame, max_age_seconds: int = 1800, delay: str = "10 minutes", keep_seconds: int = 86400
) -> DataFrame:
    """Per feedback row one candidate by session, and one by query id if it names one, both in the same micro-batch; late feedback once or twice
    with ``late``. ``queries(query_id, session_id, ts)``, ``feedback(feedback_id, session_id, query_id, ts)``, ids whole numbers. Named
    queries are remembered for ``keep_seconds`` of event time."""
    age = max_age_seconds * 1000000
    us = F.unix_micros("ts")

    def slice_(at):
        return F.floor(at / (SLICE_AGES * age)).cast("bigint")

    def at(part, who, buckets, where, by=None):
        bucket = F.pmod(F.xxhash64(who if by is None else by), F.lit(buckets)).cast("int")
        return F.struct(F.lit(part).alias("part"), bucket.alias("bucket"), where.alias("slice"), who.alias("who"))

    def by_id():
        who = F.col("query_id").cast("string")
        return F.when(who.isNotNull(), at("i", who, ID_BUCKETS, F.lit(0).cast("bigint")))

    session = F.col("session_id").cast("string")
    now, next_ = (at("s", session, SESSION_BUCKETS, slice_(x)) for x in (us, us + age))
    asked = queries.withWatermark("ts", delay).select(
        F.lit("q").alias("kind"), us.alias("us"), F.col("query_id").cast("bigint").alias("id"),
        F.array(F.when(session.isNotNull(), now), F.when(session.isNotNull() & (slice_(us) < slice_(us + age)), next_), by_id()).alias("keys"),
    )
    nobody = at("n", F.lit(None).cast("string"), SESSION_BUCKETS, slice_(us), by="feedback_id")
    given = feedback.withWatermark("ts", delay).select(
        F.lit("f").alias("kind"), us.alias("us"), F.col("feedback_id").cast("bigint").alias("id"),
        F.array(F.when(session.isNotNull(), now).otherwise(nobody), by_id()).alias("keys"),
    )
    keyed = asked.unionByName(given).select("kind", "us", "id", F.explode("keys").alias("key"))
    rows = keyed.where("key IS NOT NULL").select("key.part", "key.bucket", "key.slice", "key.who", "kind", "us", "id")
    return with_state(rows, ["part", "bucket", "slice"], NewestQuery(age, keep_seconds * 1000000), SCHEMA)


def write_attribution(
    queries: DataFrame,
    feedback: DataFrame,
    matched_path: str,
    late_path: str,
    checkpoint: str,
    max_age_seconds: int = 1800,
    delay: str = "10 minutes",
    keep_seconds: int = 86400,
    once: bool = False,
    interval: str = "30 seconds",
    partitions: int | None = None,
) -> StreamingQuery:
    """Matched feedback (feedback_id, ts, matched_query_id, matched_by) to one Parquet table, late feedback (feedback_id, ts) to another,
    a folder per micro-batch each; repeating a batch gives the same tables. A named query that exists comes before the session's newest."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        order = F.struct(F.col("matched_by").eqNullSafe("query_id").alias("named"), "matched_query_id", "matched_by")
        best = batch.where(~F.col("late")).groupBy("feedback_id", "us").agg(F.max(order).alias("m"))
        matched = best.select("feedback_id", F.timestamp_micros("us").alias("ts"), "m.matched_query_id", "m.matched_by")
        late = batch.where("late").select("feedback_id", F.timestamp_micros("us").alias("ts")).distinct()
        for part, path in ((matched, matched_path), (late, late_path)):
            part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    stream = attribution_candidates(queries, feedback, max_age_seconds, delay, keep_seconds)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    with rocksdb(stream.sparkSession, partitions):
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
