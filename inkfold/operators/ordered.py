"""Ordered computations per key that do not put a whole key into one task.

A plain window over a key sorts all its rows in one task; one hot key (a model, a metric, the
'anonymous' session) would then stall the job. Here the rows are range-partitioned by key, time and
tie, with bounds that Spark takes from the data: a hot key, or a load peak at one moment, spans as
many blocks as its rows need. The blocks are pinned by a checkpoint, so that every later pass sees
the same ones. A first pass reduces every (key, block) to one summary row with map-side combining;
windows over these few summary rows carry the state into each block; the fine-grained window then
runs per (key, block). Results are the same as those of the plain window. Rows without a key or a
time have no place in an order: ``as_of`` returns them unmatched, the others leave them out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.session import checkpointed

CHUNK = "_chunk"
BLOCK_BITS = 16
_CARRY = "_carry"


def with_chunk(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """Add the block column. Frames that have it keep it through all functions here: a chain of
    them then runs on one partitioning by (key, block). A block is a run of at most 2 ** ``BLOCK_BITS``
    rows of a range partition in order, so its size does not grow with the table."""
    if CHUNK in df.columns:
        return df
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = F.col(ts).isNotNull()
    for key in keys:
        placed = placed & F.col(key).isNotNull()
    order = [F.col(c) for c in (*keys, ts, *tie)]
    spread = df.where(placed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id of a row is its partition and its number there.
    return checkpointed(spread.withColumn(CHUNK, F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))


def _extra(df: DataFrame) -> list[str]:
    """Helper columns to drop again: the block, unless the caller's frame had it."""
    return [] if CHUNK in df.columns else [CHUNK]


def _before(keys: Sequence[str]):
    return (
        Window.partitionBy(*keys)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: Column,
    out: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including this one."""
    chunked = with_chunk(df, keys, ts, tie).withColumn("_v", value)
    carry = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.sum("_v").alias("_s"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_s").over(_before(keys)), F.lit(0)).alias(_CARRY))
    )
    inside = _inside(keys, [ts, *tie]).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.join(carry, [*keys, CHUNK])
        .withColumn(out, F.col(_CARRY) + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop(*_extra(df), _CARRY, "_v")
    )


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    out: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """1-based position of each row within its key."""
    return running_sum(df, keys, ts, F.lit(1).cast("bigint"), out, tie)


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    out: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """``value`` of the row before this one within its key (null for the first)."""
    return _neighbour(df, keys, ts, value, out, tie, forward=False)


def next_value(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    out: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """``value`` of the row after this one within its key (null for the last)."""
    return _neighbour(df, keys, ts, value, out, tie, forward=True)


def _neighbour(df, keys, ts, value, out, tie, forward):
    chunked = with_chunk(df, keys, ts, tie)
    order = F.struct(ts, *tie)
    edge = F.min_by(F.struct(value), order) if forward else F.max_by(F.struct(value), order)
    shift = F.lead if forward else F.lag
    carry = (
        chunked.groupBy(*keys, CHUNK)
        .agg(edge.alias("_edge"))
        .select(
            *keys, CHUNK, shift("_edge").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias(_CARRY)
        )
    )
    near = shift(F.struct(value)).over(_inside(keys, [ts, *tie]))
    return (
        chunked.join(carry, [*keys, CHUNK])
        .withColumn(out, F.coalesce(near, F.col(_CARRY))[value])
        .drop(*_extra(df), _CARRY)
    )


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: Column,
    out: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Last non-null ``value`` of the key up to and including this row."""
    chunked = with_chunk(df, keys, ts, tie).withColumn("_v", value)
    order = F.when(F.col("_v").isNotNull(), F.struct(ts, *tie))
    carry = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.max_by("_v", order).alias("_last"))
        .select(*keys, CHUNK, F.last("_last", ignorenulls=True).over(_before(keys)).alias(_CARRY))
    )
    inside = _inside(keys, [ts, *tie]).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.join(carry, [*keys, CHUNK])
        .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col(_CARRY)))
        .drop(*_extra(df), _CARRY, "_v")
    )


def run_start(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    state: Column,
    starts: Callable[[Column, Column], Column],
    out: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Time of the latest row, up to and including this one, at which a run starts.

    ``starts(previous_state, state)`` says whether a row starts a run, given the state of the row
    before it in its key (null for the first). One pass carries both facts across chunks."""
    inside = _inside(keys, [ts, *tie])
    known = F.lag(F.lit(True)).over(inside)
    chunked = with_chunk(df, keys, ts, tie).withColumn("_st", state)
    marked = (
        chunked.withColumn("_pr", F.lag("_st").over(inside))
        .withColumn("_inner", known.isNotNull())
        .withColumn("_end_row", F.lead(F.lit(True)).over(inside).isNull())
        .withColumn("_local", F.when(F.col("_inner") & starts(F.col("_pr"), F.col("_st")), F.col(ts)))
    )
    # The first and last rows are known from the ordered pass, so plain maxima pick their states.
    summary = marked.groupBy(*keys, CHUNK).agg(
        F.max(F.when(~F.col("_inner"), F.col("_st"))).alias("_first"),
        F.max(F.when(F.col("_end_row"), F.col("_st"))).alias("_last"),
        F.min(ts).alias("_t0"),
        F.max("_local").alias("_run"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    opened = F.when(
        F.coalesce(starts(F.lag("_last").over(by_chunk), F.col("_first")), F.lit(False)),
        F.col("_t0"),
    )
    carry = (
        summary.withColumn("_open", opened)
        .withColumn("_end", F.coalesce("_run", "_open"))
        .select(
            *keys,
            CHUNK,
            F.coalesce("_open", F.last("_end", ignorenulls=True).over(_before(keys))).alias(_CARRY),
        )
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.join(carry, [*keys, CHUNK])
        .withColumn(out, F.coalesce(F.last("_local", ignorenulls=True).over(upto), F.col(_CARRY)))
        .drop(*_extra(df), _CARRY, "_st", "_pr", "_inner", "_end_row", "_local")
    )


def as_of(
    rows: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    ts: str,
    payload: Sequence[str],
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add to each row the ``payload`` columns of the latest mark of its key with
    ``mark.ts <= row.ts``. ``tie`` (columns of ``marks``) orders marks of one instant."""
    mark_type = F.struct(*payload)
    ties = F.struct(*tie) if tie else F.lit(0)
    known = F.col(ts).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    left = rows.where(known).select(
        *keys, F.col(ts).alias("_ts"), F.lit(1).alias("_kind"), F.struct("*").alias("_row")
    )
    right = marks.where(known).select(
        *keys, F.col(ts).alias("_ts"), F.lit(0).alias("_kind"), ties.alias("_tie"),
        mark_type.alias("_mark"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    filled = carry_last(both, keys, "_ts", F.col("_mark"), "_found", ["_kind", "_tie"])
    found = filled.where(F.col("_kind") == 1).select(
        "_row.*", *[F.col("_found")[c].alias(c) for c in payload]
    )
    return found.unionByName(rows.where(~known), allowMissingColumns=True)


def trailing_sum(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    window_seconds: int,
    out: str,
) -> DataFrame:
    """Sum of ``value`` over the rows of the key in (ts - window, ts]. Nothing is ever subtracted, so
    a value that has left leaves no trace, however large (or infinite) it was.

    Time is cut into cells of one window. The window of a row is the start of its own cell up to the
    row, plus the end of the cell before. So each value enters its own cell at its time, and the next
    cell at the time at which it leaves; in every cell one running sum goes forward over the former
    and one backward over the latter. Both run over one row per instant and in row-bounded blocks."""
    micros = window_seconds * 1000000
    at = F.unix_micros(F.col(ts))
    cell = F.floor(at / micros).cast("bigint")
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))

    def entry(c: Column, us: Column, own: Column, late: Column) -> Column:
        return F.struct(c.alias("c"), us.alias("us"), own.alias("own"), late.alias("late"))

    entries = F.array(entry(cell, at, v, F.lit(0.0)), entry(cell + 1, at + micros, F.lit(0.0), v))
    instants = (
        df.select(*keys, F.explode(entries).alias("_e"))
        .groupBy(*keys, F.col("_e.c").alias("_cell"), F.col("_e.us").alias("_us"))
        .agg(F.sum("_e.own").alias("_own"), F.sum("_e.late").alias("_late"))
    )
    group = [*keys, "_cell"]
    placed = with_chunk(instants, group, "_us")
    forward = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy(*group).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        placed.groupBy(*group, CHUNK)
        .agg(F.sum("_own").alias("_o"), F.sum("_late").alias("_l"))
        .select(
            *group, CHUNK, F.coalesce(F.sum("_o").over(forward), F.lit(0.0)).alias("_of"),
            F.coalesce(F.sum("_l").over(backward), F.lit(0.0)).alias("_lf"),
        )
    )
    inside = Window.partitionBy(*group, CHUNK)
    upto = inside.orderBy("_us").rowsBetween(Window.unboundedPreceding, 0)
    after = inside.orderBy(F.desc("_us")).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.join(carry, [*group, CHUNK]).select(
        *keys,
        F.timestamp_micros("_us").alias(ts),
        (
            F.col("_of") + F.sum("_own").over(upto)
            + (F.col("_lf") + F.coalesce(F.sum("_late").over(after), F.lit(0.0)))
        ).alias(out),
    )
    return df.join(sums, [*keys, ts])
