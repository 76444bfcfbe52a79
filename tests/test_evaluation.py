import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from inkfold.operators import evaluation as E
from inkfold.schemas import CONTRACTS


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_confidence(spark):
    tokens = spark.createDataFrame([("b", 0.0), ("c", 1.0), ("c", 1.0), ("d", 0.5), ("d", 0.5), ("e", None)], "region_id STRING, p DOUBLE")
    regions = spark.createDataFrame([(r,) for r in "abcd"], "region_id STRING")
    got = {r.region_id: r.htr_confidence for r in E.sequence_confidence(tokens, regions).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 1.0, "d": 0.5}
    flags = E.flag_low_confidence(E.sequence_confidence(tokens)).collect()
    assert {r.region_id: r.htr_flagged for r in flags} == {"b": True, "c": False, "d": False, "e": False}


def test_edit_distance_is_exact(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(60):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 500)))
        b = list(a)
        for _ in range(rng.choice([0, 3, 30, 400])):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abxy"))
            if len(b) > 3:
                b.pop(rng.randrange(len(b)))
        pairs.append((a, "".join(b)))
    pairs += [("", "abc"), ("abc", ""), ("bc", "abcd"), ("kitten", "sitting")]
    df = spark.createDataFrame(pairs, "a STRING, b STRING")
    got = E.with_edit_distance(df.select("a", "b"), F.col("a"), F.col("b"), "d").collect()
    assert all(r.d == levenshtein(r.a, r.b) for r in got)


def test_cer(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "x"), (" ", "y"), (None, "z")], "reference STRING, hypothesis STRING")
    row = E.corpus_cer(df).first()
    assert (row.pairs, row.edits, row.reference_chars, row.cer) == (1, 3, 6, 0.5)
    assert E.corpus_cer(df.where("reference = ''")).first().cer == 1.0
    assert E.corpus_cer(df.where("false")).first().cer == 1.0


def requests(spark, latencies, status=200):
    rows = [("e", 1, float(x), status) for x in latencies]
    df = spark.createDataFrame(rows, "endpoint STRING, concurrency INT, latency_ms DOUBLE, status INT")
    return df.withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))


def test_benchmark(spark):
    row = E.endpoint_benchmark(requests(spark, range(1, 101))).first()
    assert (row.num_requests, row.p50_ms, row.p95_ms, row.error_rate) == (100, 50.5, 96.0, 0.0)
    assert (row.wall_time_s, row.throughput_rps) == (0.1, 1000.0)
    one = E.endpoint_benchmark(requests(spark, [7], 503)).first()
    assert (one.p50_ms, one.p95_ms, one.error_rate) == (7.0, 7.0, 1.0)
    head = E.benchmark_headline(E.endpoint_benchmark(requests(spark, [7], 503))).first()
    assert head.max_error_rate == 1.0
    fast = E.endpoint_benchmark(requests(spark, range(1, 101)), approximate=True).first()
    assert fast.p50_ms in (50.0, 51.0)


@pytest.mark.parametrize("spread", [10**9, 40])
def test_order_statistics_through_sketch_brackets(spark, spread):
    """Brackets from the sketch, with distinct and with heavily repeated values."""
    rng = random.Random(4)
    data = {k: [float(rng.randrange(spread)) for _ in range(n)] for k, n in (("a", 30000), ("b", 1), ("c", 20011))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k STRING, v DOUBLE")
    ranks = {
        "lo": (0.5, lambda n: F.floor((n - 1) / 2)), "hi": (0.5, lambda n: F.floor(n / 2)), "p95": (0.95, lambda n: F.floor(n * 0.95)),
    }
    got = {r.k: r for r in E.exact_order_statistics(df, ["k"], "v", ranks).collect()}
    for k, values in data.items():
        values.sort()
        assert (got[k].lo + got[k].hi) / 2 == statistics.median(values)
        assert got[k].p95 == values[int(len(values) * 0.95)] and got[k].n == len(values)


def errors_by_rule(body, contract):
    types = {"str": str, "int": int, "float": float, "bool": bool, "list": list, "dict": dict}
    out = []
    for key, kind in contract.items():
        if key not in body:
            out.append(f"missing field: {key}")
        elif not (kind in ("int", "float") and isinstance(body[key], (int, float))) and not isinstance(body[key], types[kind]):
            out.append(f"field '{key}': expected {kind}, got {type(body[key]).__name__}")
    return out


def test_contracts(spark):
    good = {"session_id": "s", "query_text": "q", "results": [], "fallback_to_keyword": False, "model_version": "v", "inference_time_ms": 3}
    bodies = [
        good, {**good, "extra": 1}, {**good, "inference_time_ms": 2.5}, {**good, "inference_time_ms": True}, {**good, "results": {"a": 1}},
        {**good, "fallback_to_keyword": 0}, {**good, "session_id": None}, {**good, "query_text": ["x"], "results": "no"}, {"results": [{"a": 1}]}, {},
        {**good, "inference_time_ms": "3"}, {**good, "model_version": 1e30},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(99, "{broken"), (98, "[1]")], "i INT, body STRING")
    contract = CONTRACTS["search_output"]
    got = {r.i: r.violations for r in E.contract_violations(df, contract).collect()}
    assert {i: got[i] for i in range(len(bodies))} == {i: errors_by_rule(b, contract) for i, b in enumerate(bodies)}
    assert got[99] == got[98] == ["not a JSON object"]


def test_dataset_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id INT, t STRING")
    checks = E.dataset_checks(df, "lines", {"has_text": F.col("t") != "", "positive": F.col("id") > 0})
    got = {r.check_name: (r.passed, r.rows_checked, r.rows_failed) for r in checks.collect()}
    assert got == {"has_text": (False, 2, 1), "positive": (True, 2, 0)}
    line = E.dataset_lineage(checks, "s3://b/lines", F.current_timestamp()).first()
    assert (line.row_count, line.valid, len(line.checks)) == (2, False, 2)


def test_gates(spark):
    lines = [
        (1, 1, "htr : {'status': 'FAIL', 'reason': 'cer', 'x': 1}"), (1, 2, "noise"), (1, 3, "htr : {'status': 'PASS', 'reason': 'PASS'}"),
        (1, 4, "retrieval: {'a': 1, 'status': 'FAIL', 'reason': ''}"), (2, 1, "htr : {'status': 'FAIL', 'reason': '" + "r" * 150 + "'}"), (3, 1, " htr : {'status': 'PASS', 'reason': ''}"),
    ]
    df = spark.createDataFrame(lines, "run_id INT, line_no INT, line STRING")
    got = {(r.model, r.failure_reason): (r.passes, r.failures) for r in E.gate_outcomes(df).collect()}
    assert got == {("htr", None): (1, 0), ("retrieval", "unspecified"): (0, 1), ("htr", "r" * 100): (0, 1)}
    assert {r.run_id: r.any_passed for r in E.gate_runs(df).collect()} == {1: True, 2: False}


def test_score_regions(spark):
    def model():
        def run(images):
            assert 1 <= len(images) <= 3
            if b"bad" in images:
                raise ValueError("no image")
            return [(image.decode(), [0.5, 0.5] if image != b"" else []) for image in images]

        return run

    df = spark.createDataFrame([("a", bytearray(b"hi")), ("b", bytearray(b"bad")), ("c", bytearray(b""))], "region_id STRING, image BINARY")
    got = {r.region_id: (r.htr_output, r.htr_confidence, r.htr_flagged, r.error) for r in E.score_regions(df.coalesce(1), model, batch=3).collect()}
    assert got == {"a": ("hi", 0.5, False, None), "b": (None, None, None, "ValueError: no image"), "c": ("", 1.0, False, None)}


def test_quality_by_source(spark):
    df = spark.createDataFrame([("r1", "x", 0.5, True), ("r2", "x", 0.7, False)], "region_id STRING, source STRING, htr_confidence DOUBLE, corrected BOOLEAN")
    assert tuple(E.quality_by_source(df).first()) == ("x", 2, 0.6, 0.5)


def test_bit_parallel_distance():
    rng = random.Random(8)
    for _ in range(400):
        a = "".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 150)))
        b = "".join(c for c in a if rng.random() > 0.1) if rng.random() < 0.5 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 90)))
        assert E.bit_parallel_distance(a, b) == levenshtein(a, b)


def test_edit_distance_of_near_far_and_null_texts(spark):
    long = "abcdefghij" * 400
    data = [("abc", "abd"), ("", "x"), (None, "x"), ("same", "same"), ("in the middle", "middle"), (long, long[::-1]), (long, "x" + long[5:3000] + "yy"), ("é🙂" * 40, "🙂é" * 30)]
    df = spark.createDataFrame(data, "a STRING, b STRING")
    got = {(r.a, r.b): r.d for r in E.with_edit_distance(df, F.col("a"), F.col("b"), "d").collect()}
    assert got == {(a, b): None if a is None else levenshtein(a, b) for a, b in data}
