"""Model lifecycle: alias history, serving version at a time, rollback and retrain decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.operators.ordered import (
    CHUNK,
    as_of,
    next_value,
    running_sum,
    with_chunk,
)
from inkfold.session import checkpointed

NEVER = 1e9  # hours since the last run when there was none


def promotion_target(versions: DataFrame) -> DataFrame:
    """Per model the numerically largest registered version (versions are text)."""
    return versions.groupBy("model").agg(F.max(F.col("version").cast("bigint")).alias("version"))


def alias_timeline(log: DataFrame) -> DataFrame:
    """Serving intervals [valid_from, valid_to) per model from promote / rollback log rows
    ``(model, ts, version)``; the last interval is open (null end)."""
    dated = log.withColumn("_from", F.col("ts"))
    ended = next_value(dated, ["model"], "ts", "_from", "valid_to", ["version"])
    return ended.select("model", "version", F.col("ts").alias("valid_from"), "valid_to")


def serving_version_as_of(events: DataFrame, log: DataFrame) -> DataFrame:
    """Add ``serving_version``: the version in service when the event happened (null before the
    first promotion). Ordered pass per (model, block), so one busy model is no hot spot."""
    marks = log.select("model", "ts", F.col("version").alias("serving_version"))
    return as_of(events, marks, ["model"], "ts", ["serving_version"], ["serving_version"])


def _accepted_attempts(firing: DataFrame, cooldown_seconds: int) -> DataFrame:
    """Add ``accepted`` and ``last_accepted_us``: an attempt is accepted when the last accepted
    one of its (model, alertname) lies at least the cooldown back.

    Accepted attempts are a chain: each leads to the first attempt a cooldown later. A burst without any
    quiet gap may hold all attempts of a name, so the chain is not followed row by row. Attempts lie in
    row-bounded blocks in time order; in a block every attempt knows the last one that a chain through it
    accepts there (its exit). The exits are linked to the exits of the blocks they lead to, and those that
    the first attempt leads to are found by doubling the links: as many rounds as the logarithm of the
    number of blocks. Then every block is walked on its own, from the attempt at which the chain enters it."""
    keys = ["model", "alertname"]
    pause = cooldown_seconds * 1000000
    timed = with_chunk(firing.withColumn("_us", F.unix_micros("received_at")), keys, "received_at", ["alert_id"])
    if pause <= 0:
        return timed.select(*keys, "alert_id", "received_at", F.lit(True).alias("accepted"), F.col("_us").alias("last_accepted_us"))
    place = [*keys, CHUNK]
    instants = timed.groupBy(*place, "_us").agg(F.count("*").alias("_n"))

    def leave(block: pd.DataFrame) -> pd.DataFrame:
        """The exit of each instant: where the next one lies beyond the block, itself, else that of the next one."""
        block = block.sort_values("_us", kind="stable")
        us = block["_us"].to_numpy()
        after = np.searchsorted(us, us + pause)
        exits = us.copy()
        for i in range(len(us) - 1, -1, -1):
            if after[i] < len(us):
                exits[i] = exits[after[i]]
        return block[place].assign(us=us, exit=exits)

    kinds = f"model STRING, alertname STRING, {CHUNK} BIGINT, us BIGINT, exit BIGINT"
    walked = checkpointed(instants.groupBy(*place).applyInPandas(leave, kinds))
    # The first instant a cooldown or more after each exit: the newest one in reversed time. Of an instant on both sides of a
    # cut, the first block has the attempt that is accepted.
    exits = walked.where("us = exit").select(*keys, F.col("us").alias("at"), (-(F.col("us") + pause)).alias("back")).distinct()
    marks = walked.select(
        *keys, (-F.col("us")).alias("back"), F.col("us").alias("enters"), F.col("exit").alias("to"),
        F.col(CHUNK).alias("_block"), (-F.col(CHUNK)).alias("_tie"),
    )
    links = as_of(exits, marks, keys, "back", ["enters", "to", "_block"], ["_tie"])
    links = checkpointed(links.select(*keys, "at", "enters", "to", "_block"))
    first = walked.groupBy(*keys).agg(F.min(F.struct("us", CHUNK, "exit")).alias("f"))
    first = first.select(*keys, F.col("f.us").alias("enters"), F.col("f.exit").alias("at"), F.col(f"f.{CHUNK}").alias("_block"))

    # After k rounds ``met`` holds the first 2 ** k exits of the chain, and ``jump`` leads 2 ** k links on.
    met = checkpointed(first.select(*keys, "at"))
    jump = links.where("to IS NOT NULL").select(*keys, "at", "to")
    while True:
        ahead = checkpointed(met.join(jump, [*keys, "at"]).select(*keys, F.col("to").alias("at")))
        if ahead.isEmpty():
            break
        met = checkpointed(met.unionByName(ahead))
        onward = jump.select(*keys, F.col("at").alias("to"), F.col("to").alias("_on"))
        jump = checkpointed(jump.join(onward, [*keys, "to"]).select(*keys, "at", F.col("_on").alias("to")))

    entered = met.join(links.where("enters IS NOT NULL"), [*keys, "at"]).select(*keys, "_block", "enters", F.col("to").alias("exit"))
    entered = entered.unionByName(first.select(*keys, "_block", "enters", F.col("at").alias("exit")))
    entries = entered.withColumnRenamed("_block", CHUNK)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = walked.select(*place).distinct().join(entries, place, "left")
    blocks = blocks.withColumn("carried", F.max("exit").over(earlier)).select(*place, "enters", "carried")

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["_us", "alert_id"], kind="stable")
        us = block["_us"].to_numpy()
        accepted, last = np.zeros(len(us), dtype=bool), np.zeros(len(us), dtype=np.int64)
        enters, carried = block["enters"].iloc[0], block["carried"].iloc[0]
        at = len(us) if pd.isna(enters) else int(np.searchsorted(us, int(enters)))
        if at > 0:
            last[:at] = int(carried)
        while at < len(us):
            accepted[at] = True
            after = int(np.searchsorted(us, us[at] + pause))
            last[at:after] = us[at]
            at = after
        return block[["model", "alertname", "alert_id", "received_at"]].assign(accepted=accepted, last_accepted_us=last)

    fields = dict(timed.dtypes)
    schema = (
        f"model STRING, alertname STRING, alert_id {fields['alert_id']}, received_at TIMESTAMP, "
        "accepted BOOLEAN, last_accepted_us BIGINT"
    )
    rows = timed.select(*place, "_us", "alert_id", "received_at").join(blocks, place)
    return rows.groupBy(*place).applyInPandas(walk, schema)


def rollback_decisions(
    alerts: DataFrame,
    promotions: DataFrame,
    cooldown_seconds: int = 300,
    versions: DataFrame | None = None,
) -> DataFrame:
    """Decision per alert: skipped_not_firing, log_only, skipped_cooldown or rollback, with the
    outcome of a rollback (rollback_complete, at_version_floor, no_registered_versions).

    ``alerts(alert_id, model, received_at, status, labels)``, ``promotions(model, ts, version)``.
    Every accepted attempt starts the cooldown of its alert name, also one that ends at the
    floor. The version falls by one per accepted attempt since the last promotion; before the first
    one it starts at the model's largest registered version (``versions(model, version)``)."""
    named = alerts.select(
        "alert_id",
        "model",
        F.coalesce(F.col("labels")["alertname"], F.lit("<unknown>")).alias("alertname"),
        "received_at",
        F.when(~F.coalesce(F.col("status") == "firing", F.lit(False)), "skipped_not_firing")
        .when(~F.coalesce(F.col("labels")["rollback_trigger"] == "true", F.lit(False)), "log_only")
        .alias("action"),
    )
    head = ["alert_id", "model", "alertname", "received_at", "action"]
    plain = named.where(F.col("action").isNotNull())
    # Read by several passes below; pinned, so that the fold over all attempts runs once.
    attempts = checkpointed(
        _accepted_attempts(named.where(F.col("action").isNull()), cooldown_seconds)
    )
    marks = promotions.select("model", "ts", "version", F.unix_micros("ts").alias("_segment"))
    based = as_of(
        attempts.withColumn("ts", F.col("received_at")),
        marks, ["model"], "ts", ["version", "_segment"], ["version"],
    ).withColumn("_segment", F.coalesce("_segment", F.lit(-1)))
    if versions is not None:
        registered = promotion_target(versions).withColumnRenamed("version", "_registered")
        based = based.join(registered, "model", "left").withColumn(
            "version", F.coalesce("version", "_registered")
        ).drop("_registered")
    one = F.col("accepted").cast("bigint")
    counted = running_sum(based, ["model", "_segment"], "ts", one, "_k", ["alert_id"])
    # No promotion so far: the version stays null.
    current = F.when(F.col("version") <= 1, F.col("version")).when(
        F.col("version") > 1, F.greatest(F.col("version") - F.col("_k") + 1, F.lit(1))
    )
    done = F.col("accepted")
    version = F.col("from_version")
    waited = F.unix_micros("received_at") - F.col("last_accepted_us")
    judged = counted.withColumn("from_version", F.when(done, current).cast("bigint")).select(
        *head[:-1],
        F.when(done, "rollback").otherwise("skipped_cooldown").alias("action"),
        F.when(~done, F.floor((cooldown_seconds * 1000000 - waited) / 1000000)).alias(
            "cooldown_remaining_seconds"
        ),
        F.when(done & version.isNull(), "no_registered_versions")
        .when(done & (version <= 1), "at_version_floor")
        .when(done, "rollback_complete")
        .alias("outcome"),
        "from_version",
        F.when(version > 1, version - 1).alias("to_version"),
    )
    return judged.unionByName(plain, allowMissingColumns=True)


def retrain_decisions(
    corrections: DataFrame,
    ticks: DataFrame,
    baselines: DataFrame | None = None,
    min_hours: float = 24,
    min_corrections: int = 500,
) -> DataFrame:
    """Decision per scheduler tick: skipped_too_recent (checked first),
    skipped_insufficient_corrections or triggered.

    ``corrections(model, corrected_at)``, ``ticks(model, ts, pipeline_ok[, forced])``,
    ``baselines(model, baseline)`` = correction count when the scheduler started (default: the
    count at the model's first tick). A pipeline that fails to complete leaves the state; a
    completed one resets time and baseline. A forced tick always triggers and keeps no state.

    Corrections are counted per tick in parallel; only the ticks themselves, one small row each,
    are folded in order per model."""
    marked = ticks if "forced" in ticks.columns else ticks.withColumn("forced", F.lit(False))
    tick_rows = marked.select(
        "model", "ts", F.lit(0).cast("bigint").alias("_one"), F.lit(1).alias("_tick"),
        F.coalesce("pipeline_ok", F.lit(False)).alias("pipeline_ok"),
        F.coalesce("forced", F.lit(False)).alias("forced"),
    )
    correction_rows = (
        corrections.groupBy("model", F.col("corrected_at").alias("ts"))
        .agg(F.count("*").alias("_one"))
        .select("model", "ts", "_one", F.lit(0).alias("_tick"))
    )
    both = tick_rows.unionByName(correction_rows, allowMissingColumns=True)
    counted = running_sum(
        both, ["model"], "ts", F.col("_one"), "correction_count", ["_tick"]
    ).where(F.col("_tick") == 1)
    if baselines is None:
        baselines = counted.groupBy("model").agg(
            F.min_by("correction_count", "ts").alias("baseline")
        )
    ready = (
        counted.join(baselines.select("model", "baseline"), "model", "left")
        .select(
            "model", "ts", "pipeline_ok", "forced", "correction_count",
            F.coalesce("baseline", F.lit(0)).cast("bigint").alias("baseline"),
        )
        .repartition("model")
        .sortWithinPartitions("model", "ts")
    )

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, last, base = None, None, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.model != model:
                    model, last, base = row.model, None, row.baseline
                now = row.ts.value / 1e9
                hours = NEVER if last is None else (now - last) / 3600
                delta = row.correction_count - base
                if row.forced:
                    hours, delta, decision = NEVER, row.correction_count, "triggered"
                elif hours < min_hours:
                    decision = "skipped_too_recent"
                elif delta < min_corrections:
                    decision = "skipped_insufficient_corrections"
                else:
                    decision = "triggered"
                if decision == "triggered" and row.pipeline_ok and not row.forced:
                    last, base = now, row.correction_count
                out.append((row.model, row.ts, round(hours, 2), row.correction_count, delta, decision))
            yield pd.DataFrame(
                out,
                columns=[
                    "model", "ts", "hours_since_last", "correction_count", "correction_delta",
                    "decision",
                ],
            )

    return ready.mapInPandas(
        fold,
        "model STRING, ts TIMESTAMP, hours_since_last DOUBLE, correction_count BIGINT, "
        "correction_delta BIGINT, decision STRING",
    )
