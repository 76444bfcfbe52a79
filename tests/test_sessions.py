import datetime as dt
import random

import pytest

from inkfold.operators import feedback as B
from inkfold.streaming import sessions as SS

START = dt.datetime(2024, 3, 1)
QUERIES = "query_id BIGINT, session_id STRING, ts TIMESTAMP"
FEEDBACK = "feedback_id BIGINT, session_id STRING, query_id BIGINT, ts TIMESTAMP"


def at(second):
    return START + dt.timedelta(seconds=second)


def run(spark, tmp_path, batches, **options):
    """Each batch (queries, feedback) is one micro-batch; the state is taken up again from the checkpoint."""
    for i, (queries, feedback) in enumerate(batches):
        for name, rows, schema in (("q", queries, QUERIES), ("f", feedback, FEEDBACK)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        asked, given = (spark.readStream.schema(x).parquet(f"{tmp_path}/{n}") for n, x in (("q", QUERIES), ("f", FEEDBACK)))
        SS.write_attribution(asked, given, f"{tmp_path}/m", f"{tmp_path}/l", f"{tmp_path}/c", once=True, **options).awaitTermination()
    matched = {r.feedback_id: (r.matched_query_id, r.matched_by) for r in spark.read.parquet(f"{tmp_path}/m").collect()}
    late = sorted(r.feedback_id for r in spark.read.parquet(f"{tmp_path}/l").collect())
    return matched, late


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch_form_whatever_the_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    sessions = ["anonymous"] * 6 + ["a", "b", None]
    queries = [(i, rng.choice(sessions), at(rng.randrange(14400))) for i in range(150)]
    queries += [(200, "anonymous", at(777)), (201, "anonymous", at(777))]
    feedback = [(1000, "anonymous", None, at(777)), (1001, "anonymous", 999, at(778)), (1002, None, 3, at(9000)), (1003, None, None, at(9000))]
    feedback += [(1100 + i, rng.choice(sessions), rng.choice([None, None, rng.randrange(180)]), at(rng.randrange(14400))) for i in range(150)]
    arrive = lambda row: (row[-1] - START).seconds + rng.randrange(1200)
    batches = [([], []) for _ in range(4)]
    for side, rows in ((0, queries), (1, feedback)):
        for row in rows:
            batches[min(3, arrive(row) // 3900)][side].append(row)
    for b in batches:
        rng.shuffle(b[0])
        rng.shuffle(b[1])
    closing = ([(-1, "z", at(80000))], [(-2, "z", None, at(80000))])
    # Watermarks trail by more than rows are out of order, so nothing is late; named queries may come after their feedback.
    matched, late = run(spark, tmp_path, [*batches, closing], max_age_seconds=1800, delay="90 minutes")
    assert late == []
    want = B.attribute_feedback(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(feedback, FEEDBACK), 1800)
    named = {q[0]: q[2] for q in queries}
    expected = {r.feedback_id: (r.matched_query_id, r.matched_by) for r in want.collect()}
    # A named query is looked for among those seen when the watermark passes the feedback.
    sure = {i for i, _, q, ts in feedback if q not in named or named[q] <= ts}
    assert len(sure) > 100 and {i: matched[i] for i in sure} == {i: expected[i] for i in sure}
    assert set(matched) == set(expected)


def test_late_feedback_is_counted_and_state_goes(spark, tmp_path):
    batches = [
        ([(1, "s", at(100))], [(10, "s", None, at(200))]),
        ([(2, "x", at(20000))], [(11, "x", None, at(20000))]),
        ([(3, "s", at(150))], [(12, "s", None, at(210)), (13, "s", None, at(20001))]),
        ([(9, "z", at(90000))], [(99, "z", None, at(90000))]),
    ]
    matched, late = run(spark, tmp_path, batches, max_age_seconds=1800, delay="1 minute")
    assert matched == {10: (1, "session"), 11: (2, "session"), 13: (None, None)} and late == [12]


def test_keys_do_not_grow_with_sessions_and_queries(spark, tmp_path):
    """800 sessions and as many queries named by id share the buckets of their slice; state is read and written by bucket."""
    n = 800
    spark.createDataFrame([(i, f"s{i}", at(i % 60)) for i in range(n)], QUERIES).write.parquet(f"{tmp_path}/q")
    spark.createDataFrame([(n + i, f"s{i}", i, at(i % 60 + 5)) for i in range(n)], FEEDBACK).write.parquet(f"{tmp_path}/f")
    asked, given = (spark.readStream.schema(x).parquet(f"{tmp_path}/{k}") for k, x in (("q", QUERIES), ("f", FEEDBACK)))
    query = SS.write_attribution(asked, given, f"{tmp_path}/m", f"{tmp_path}/l", f"{tmp_path}/c", once=True, partitions=2)
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 200
