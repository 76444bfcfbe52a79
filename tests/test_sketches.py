import datetime as dt
import random

import numpy as np

from inkfold.operators import sketches as K

SCHEMA = "endpoint STRING, concurrency INT, started_at TIMESTAMP, latency_ms DOUBLE"


def test_stored_sketches_answer_within_the_rank_error(spark, tmp_path):
    rng = random.Random(1)
    start = dt.datetime(2024, 3, 1)
    data = [("a" if i % 3 else "b", 1 + i % 2, start + dt.timedelta(minutes=i % 3000), rng.lognormvariate(3, 1)) for i in range(30000)]
    raw = spark.createDataFrame([*data, ("a", 1, start, None)], SCHEMA)
    path = str(tmp_path / "sketches")
    K.latency_sketches(raw).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 * 2 * 50
    for keys, pick in ((["endpoint"], lambda r: (r[0],)), (["endpoint", "concurrency"], lambda r: r[:2]), ([], lambda r: ())):
        values = {}
        for r in data:
            values.setdefault(pick(r), []).append(r[3])
        got = K.sketch_quantiles(stored, keys, [0.5, 0.95, 0.99]).collect()
        assert len(got) == 3 * len(values)
        for r in got:
            own = np.array(values[tuple(r[k] for k in keys)])
            assert r.requests == len(own) and abs((own <= r.latency_ms).mean() - r.share) <= 2 * K.rank_error()


def test_a_range_of_hours(spark):
    start = dt.datetime(2024, 3, 1)
    raw = spark.createDataFrame([("a", 1, start + dt.timedelta(hours=h), float(h)) for h in range(10) for _ in range(5)], SCHEMA)
    late = K.latency_sketches(raw).where("hour >= timestamp '2024-03-01 05:00:00'")
    assert K.sketch_quantiles(late, ["endpoint"], [0.0, 1.0]).orderBy("share").toPandas().latency_ms.tolist() == [5.0, 9.0]
    assert K.sketch_quantiles(late.limit(0), ["endpoint"], [0.5]).count() == 0
