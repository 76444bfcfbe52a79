"""Model and service evaluation: confidence, CER, latency statistics, contracts, gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.operators.ordered import running_sum, with_chunk

MIN_PROBABILITY = 1e-12
# Format of a gate's output line (fixed value).
GATE_LINE = r"^(\w+)\s*:\s*\{.*'status':\s*'(\w+)'.*'reason':\s*'([^']*)'"


def sequence_confidence(tokens: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Geometric mean of the token probabilities per region, rounded to 4. A region of
    ``regions`` without tokens has confidence 1."""
    safe = F.when(F.col("p").isNotNull(), F.greatest(F.col("p"), F.lit(MIN_PROBABILITY)))
    scored = tokens.groupBy("region_id").agg(
        F.count("p").alias("tokens"),
        F.round(F.exp(F.coalesce(F.avg(F.log(safe)), F.lit(0.0))), 4).alias("htr_confidence"),
    )
    if regions is None:
        return scored
    return (
        regions.select("region_id")
        .join(scored, "region_id", "left")
        .select(
            "region_id",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("htr_confidence", F.lit(1.0)).alias("htr_confidence"),
        )
    )


def flag_low_confidence(regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    return regions.withColumn("htr_flagged", F.col("htr_confidence") < threshold)


def score_regions(
    regions: DataFrame,
    make_model: Callable[[], Callable[[list[bytes]], Sequence[tuple[str, Sequence[float]]]]],
    threshold: float = 0.5,
    model_version: str = "htr_v1",
    batch: int = 8,
) -> DataFrame:
    """Batch recognition of ``regions(region_id, image)``. ``make_model`` runs once per task; the model maps a list of
    at most ``batch`` images to a (text, token probabilities) each. If a list fails, its images are tried one by one: a
    failing image gets an ``error`` and fails neither the job nor its neighbours."""
    import math

    schema = "region_id STRING, htr_output STRING, htr_confidence DOUBLE, error STRING"

    def row(region_id: str, found: tuple[str, Sequence[float]]) -> tuple:
        text, probs = found
        logs = [math.log(max(p, MIN_PROBABILITY)) for p in probs]
        return (region_id, text, round(math.exp(sum(logs) / max(len(logs), 1)), 4), None)

    def read(model, ids: list[str], images: list[bytes]) -> list[tuple]:
        try:
            found = list(model(images))
            if len(found) != len(images):
                raise ValueError(f"{len(found)} results for {len(images)} images")
            return [row(*pair) for pair in zip(ids, found, strict=True)]
        except Exception as error:
            if len(images) == 1:
                return [(ids[0], None, None, f"{type(error).__name__}: {error}")]
            return [r for i in range(len(images)) for r in read(model, ids[i : i + 1], images[i : i + 1])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            ids, images = frame["region_id"].tolist(), [bytes(x) for x in frame["image"]]
            rows = [r for i in range(0, len(ids), batch) for r in read(model, ids[i : i + batch], images[i : i + batch])]
            yield pd.DataFrame(rows, columns=["region_id", "htr_output", "htr_confidence", "error"])

    scored = regions.select(F.col("region_id").cast("string").alias("region_id"), "image")
    return flag_low_confidence(scored.mapInPandas(run, schema), threshold).withColumn(
        "model_version", F.lit(model_version)
    )


# Distances up to this are found in a band around the diagonal; farther pairs go through bit vectors.
NEAR_EDITS = 16


def bit_parallel_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors: one column of the table is two whole numbers with a bit per character, and a
    character of the longer text is a handful of operations on them. What both texts begin or end with is left out first."""
    start = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        start += 1
    a, b = a[start:], b[start:]
    end = 0
    for x, y in zip(reversed(a), reversed(b), strict=False):
        if x != y:
            break
        end += 1
    if end:
        a, b = a[:-end], b[:-end]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    size = len(a) // 8 + 1
    where = {}
    for c, at in places.items():
        bits = np.zeros(8 * size, dtype=np.uint8)
        bits[at] = 1
        where[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        equal = where.get(c, 0)
        vertical = equal | down
        level = (((equal & up) + up) ^ up) | equal
        right, left = down | (full & ~(level | up)), up & level
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        right = ((right << 1) | 1) & full
        left = (left << 1) & full
        up = left | (full & ~(vertical | right))
        down = right & vertical
    return distance


def _far_distance():
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else bit_parallel_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return distance


def with_edit_distance(df: DataFrame, a: Column, b: Column, out: str) -> DataFrame:
    """Add the Levenshtein distance of two texts: the length difference where one contains the other, else a narrow band, and only what
    is farther apart goes to Python, in Arrow batches. A null text gives null."""
    near = F.when(
        F.contains(a, b) | F.contains(b, a), F.abs(F.char_length(a) - F.char_length(b))
    ).otherwise(F.nullif(F.levenshtein(a, b, NEAR_EDITS), F.lit(-1)))
    known = df.withColumn("_near", near)
    far = F.col("_near").isNull()
    return known.withColumn(out, F.coalesce("_near", _far_distance()(F.when(far, a), F.when(far, b)))).drop("_near")


def corpus_cer(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Character error rate: all edits / all reference characters. Pairs with a blank reference
    do not count; with none left the rate is 1. ``pairs(reference, hypothesis)``."""
    from inkfold.functions.text import py_strip

    ref, hyp = F.coalesce("reference", F.lit("")), F.coalesce("hypothesis", F.lit(""))
    counted = py_strip(F.col("reference")) != ""
    texts = pairs.select(*keys, F.coalesce(counted, F.lit(False)).alias("_counted"), ref.alias("_ref"), hyp.alias("_hyp"))
    told = F.col("_counted")
    measured = with_edit_distance(texts, F.when(told, F.col("_ref")), F.when(told, F.col("_hyp")), "_edits")
    edits = F.sum("_edits")
    chars = F.sum(F.when(told, F.char_length("_ref")))
    return measured.groupBy(*keys).agg(
        F.count_if(told).alias("pairs"),
        F.coalesce(edits, F.lit(0)).alias("edits"),
        F.coalesce(chars, F.lit(0)).alias("reference_chars"),
        F.coalesce(F.try_divide(edits, chars), F.lit(1.0)).alias("cer"),
    )


def exact_order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, tuple[float, Callable[[Column], Column]]],
) -> DataFrame:
    """Exact order statistics per key without sorting a whole key in one task.

    ``ranks`` maps a name to (share, function from the row count to the 0-based rank). Equal values of
    a key become one row with their count, with map-side combining; a running sum of the counts in
    row-bounded blocks then tells which value holds each rank. Null values do not count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = with_chunk(counted, keys, value)
    totals = placed.groupBy(*keys).agg(F.sum("_c").alias("n"))
    summed = running_sum(placed, keys, value, F.col("_c"), "_upto").join(totals, list(keys))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c")), F.col(value)))

    found = [at(rank(F.col("n")).cast("bigint")).alias(name) for name, (_, rank) in ranks.items()]
    return summed.groupBy(*keys, "n").agg(*found)


def endpoint_benchmark(requests: DataFrame, approximate: bool = False) -> DataFrame:
    """Latency median and 95th percentile (element ``int(0.95 n)`` of the sorted list), throughput
    and error rate per endpoint and concurrency. The wall time spans from the first start to the
    last finish. ``requests(endpoint, concurrency, started_at, latency_ms, status)``."""
    keys = ["endpoint", "concurrency"]
    end = F.unix_micros("started_at") / 1e6 + F.col("latency_ms") / 1e3
    wall = F.max(end) - F.min(F.unix_micros("started_at") / 1e6)
    totals = requests.groupBy(*keys).agg(
        F.count("*").alias("num_requests"),
        F.round(F.try_divide(F.count("*"), wall), 2).alias("throughput_rps"),
        F.round(F.count_if(~(F.coalesce("status", F.lit(0)) == 200)) / F.count("*"), 4).alias(
            "error_rate"
        ),
        F.round(wall, 2).alias("wall_time_s"),
    )
    if approximate:
        stats = requests.groupBy(*keys).agg(
            F.percentile_approx("latency_ms", [0.5, 0.95], 10_000).alias("_q")
        ).select(*keys, F.col("_q")[0].alias("_p50"), F.col("_q")[1].alias("p95"))
    else:
        ranks = {
            "mid_low": (0.5, lambda n: F.floor((n - 1) / 2)),
            "mid_high": (0.5, lambda n: F.floor(n / 2)),
            "p95": (0.95, lambda n: F.floor(n * F.lit(0.95))),
        }
        stats = exact_order_statistics(requests, keys, "latency_ms", ranks).withColumn(
            "_p50", (F.col("mid_low") + F.col("mid_high")) / 2
        )
    return totals.join(stats, keys).select(
        *keys,
        "num_requests",
        F.round("_p50", 1).alias("p50_ms"),
        F.round("p95", 1).alias("p95_ms"),
        "throughput_rps",
        "error_rate",
        "wall_time_s",
    )


def benchmark_headline(rows: DataFrame) -> DataFrame:
    """The concurrency-1 row of each endpoint and the largest error rate of all rows."""
    worst = rows.agg(F.max("error_rate").alias("e"))
    return rows.where(F.col("concurrency") == 1).select(
        "endpoint", "p50_ms", "p95_ms", "throughput_rps", worst.scalar().alias("max_error_rate")
    )


def quality_by_source(regions: DataFrame) -> DataFrame:
    """Mean confidence and correction rate per document source.
    ``regions(region_id, source, htr_confidence, corrected)``, one row per region."""
    return regions.groupBy("source").agg(
        F.count("*").alias("regions"),
        F.round(F.avg("htr_confidence"), 4).alias("mean_confidence"),
        F.round(F.count_if("corrected") / F.count("*"), 4).alias("correction_rate"),
    )


def contract_violations(records: DataFrame, contract: dict[str, str], json: str = "body") -> DataFrame:
    """Add ``violations``: missing top-level fields and fields of the wrong JSON type. Integers
    and floats are interchangeable and a boolean passes as a number; further fields are ignored."""
    # Variant type names -> contract type names (fixed values).
    kinds = {"STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float", "VOID": "NoneType"}
    kind_map = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])

    def kind_of(value: Column) -> Column:
        raw = F.schema_of_variant(value)
        return (
            F.when(raw.startswith("OBJECT"), "dict")
            .when(raw.startswith("ARRAY"), "list")
            .when(raw.startswith("DECIMAL"), "float")
            .otherwise(kind_map[raw])
        )

    fields = [f"`{name}` variant" for name in contract]
    # The record is parsed once, to one variant per contract field; kinds are then plain text.
    parsed = records.withColumn("_names", F.json_object_keys(json)).withColumn(
        "_body", F.from_json(json, ", ".join(fields))
    )
    typed = parsed.withColumn(
        "_kinds", F.array(*[kind_of(F.col("_body")[name]) for name in contract])
    )
    errors = []
    for i, (name, expected) in enumerate(contract.items()):
        kind = F.coalesce(F.col("_kinds")[i], F.lit("NoneType"))
        passing = ["int", "float", "bool"] if expected in ("int", "float") else [expected]
        wrong = F.concat(F.lit(f"field '{name}': expected {expected}, got "), kind)
        errors.append(
            F.when(~F.array_contains("_names", name), F.lit(f"missing field: {name}")).when(
                ~kind.isin(*passing), wrong
            )
        )
    listed = F.filter(F.array(*errors), lambda e: e.isNotNull())
    return typed.withColumn(
        "violations",
        F.when(F.col("_names").isNull(), F.array(F.lit("not a JSON object"))).otherwise(listed),
    ).drop("_names", "_body", "_kinds")


def dataset_checks(df: DataFrame, dataset: str, rules: dict[str, Column]) -> DataFrame:
    """One row per rule: rows checked, rows failing, and whether the rule passed. All rules are
    evaluated in one pass over the data."""
    wide = df.agg(
        F.count("*").alias("_n"),
        *[
            F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"_r{i}")
            for i, rule in enumerate(rules.values())
        ],
    )
    rows = [
        F.struct(F.lit(name).alias("name"), F.col(f"_r{i}").alias("failed"))
        for i, name in enumerate(rules)
    ]
    return wide.select("_n", F.explode(F.array(*rows)).alias("r")).select(
        F.lit(dataset).alias("dataset"),
        F.col("r.name").alias("check_name"),
        (F.col("r.failed") == 0).alias("passed"),
        F.col("_n").alias("rows_checked"),
        F.col("r.failed").alias("rows_failed"),
    )


def dataset_lineage(checks: DataFrame, source_url: str, ingested_at: Column) -> DataFrame:
    """One lineage row per dataset: source, ingest time, row count and validator output."""
    return checks.groupBy("dataset").agg(
        F.lit(source_url).alias("source_url"),
        F.first(ingested_at).alias("ingested_at"),
        F.max("rows_checked").alias("row_count"),
        F.min("passed").alias("valid"),
        F.sort_array(
            F.collect_list(F.struct("check_name", "passed", "rows_checked", "rows_failed"))
        ).alias("checks"),
    )


def gate_results(lines: DataFrame) -> DataFrame:
    """Model, status and reason parsed from gate output; the last line per run and model wins."""
    parsed = lines.select(
        "run_id",
        "line_no",
        F.regexp_extract("line", GATE_LINE, 1).alias("model"),
        F.regexp_extract("line", GATE_LINE, 2).alias("status"),
        F.regexp_extract("line", GATE_LINE, 3).alias("reason"),
    ).where(F.col("model") != "")
    return (
        parsed.groupBy("run_id", "model")
        .agg(F.max_by(F.struct("status", "reason"), "line_no").alias("r"))
        .select("run_id", "model", "r.status", "r.reason")
    )


def gate_outcomes(lines: DataFrame) -> DataFrame:
    """Pass and fail counts per model and failure reason (cut to 100 characters, empty ->
    'unspecified'), with the number of runs in which any model passed."""
    results = gate_results(lines)
    failed = F.col("status") != "PASS"
    label = F.coalesce(F.nullif(F.substring("reason", 1, 100), F.lit("")), F.lit("unspecified"))
    return (
        results.groupBy("model", F.when(failed, label).alias("failure_reason"))
        .agg(F.count_if(~failed).alias("passes"), F.count_if(failed).alias("failures"))
    )


def gate_runs(lines: DataFrame) -> DataFrame:
    """``any_passed`` per run."""
    return gate_results(lines).groupBy("run_id").agg(
        F.count("*").alias("models"), F.max(F.col("status") == "PASS").alias("any_passed")
    )
