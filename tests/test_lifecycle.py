import datetime as dt
import random

from inkfold.operators import lifecycle as L

T0 = dt.datetime(2024, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def alerts(spark, rows):
    """rows: (id, model, second, status, alertname, trigger)"""
    data = [(i, m, at(s), st, {k: v for k, v in (("alertname", a), ("rollback_trigger", tr)) if v is not None}) for i, m, s, st, a, tr in rows]
    return spark.createDataFrame(data, "alert_id BIGINT, model STRING, received_at TIMESTAMP, status STRING, labels MAP<STRING, STRING>")


def promotions(spark, rows):
    return spark.createDataFrame([(m, at(s), v) for m, s, v in rows], "model STRING, ts TIMESTAMP, version BIGINT")


def replay(rows, promoted, cooldown):
    """One alert after the other, as a controller would take them."""
    out, last = {}, {}
    versions = {}
    todo = sorted(promoted, key=lambda p: p[1])
    for i, m, s, st, a, tr in sorted(rows, key=lambda r: (r[2], r[0])):
        while todo and todo[0][1] <= s:
            model, _, v = todo.pop(0)
            versions[model] = v
        name = a or "<unknown>"
        if st != "firing":
            out[i] = ("skipped_not_firing", None, None, None)
        elif tr != "true":
            out[i] = ("log_only", None, None, None)
        elif (m, name) in last and s - last[m, name] < cooldown:
            out[i] = ("skipped_cooldown", int(cooldown - (s - last[m, name])), None, None)
        else:
            last[m, name] = s
            now = versions.get(m)
            if now is None:
                out[i] = ("rollback", None, "no_registered_versions", None)
            elif now <= 1:
                out[i] = ("rollback", None, "at_version_floor", None)
            else:
                versions[m] = now - 1
                out[i] = ("rollback", None, "rollback_complete", now - 1)
    return out


def decided(df):
    return {r.alert_id: (r.action, r.cooldown_remaining_seconds, r.outcome, r.to_version) for r in df.collect()}


def test_demo_cases(spark):
    rows = [(i, "htr", s, "firing", a, "true") for i, (s, a) in enumerate([(0, "A"), (100, "A"), (110, "B"), (300, "A"), (310, "C")])]
    got = decided(L.rollback_decisions(alerts(spark, rows), promotions(spark, [("htr", -10, 3)])))
    assert got == {
        0: ("rollback", None, "rollback_complete", 2), 1: ("skipped_cooldown", 200, None, None), 2: ("rollback", None, "rollback_complete", 1),
        3: ("rollback", None, "at_version_floor", None), 4: ("rollback", None, "at_version_floor", None),
    }


def test_not_eligible_and_unregistered(spark):
    rows = [(1, "m", 0, "resolved", "A", "true"), (2, "m", 1, "firing", "A", None), (3, "m", 2, "firing", None, "true"), (4, "m", 3, "firing", "A", "false")]
    got = decided(L.rollback_decisions(alerts(spark, rows), promotions(spark, [("other", -10, 3)])))
    assert got == {
        1: ("skipped_not_firing", None, None, None), 2: ("log_only", None, None, None), 3: ("rollback", None, "no_registered_versions", None),
        4: ("log_only", None, None, None),
    }


def test_random_alerts_equal_a_sequential_replay(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        # Long bursts and quiet spells, over several chunks.
        second = rng.randrange(30) * 2500 + rng.randrange(1500)
        rows.append((i, rng.choice(["m1", "m1", "m1", "m2", "m3"]), second, rng.choice(["firing"] * 5 + ["resolved"]), rng.choice("AAB"), rng.choice(["true"] * 4 + ["false"])))
    promoted = [("m1", s, v) for v, s in enumerate(range(5, 70000, 9000), 4)] + [("m2", 20000, 6)]
    got = decided(L.rollback_decisions(alerts(spark, rows), promotions(spark, promoted), 300))
    assert got == replay(rows, promoted, 300)


def test_timeline_and_serving_version(spark):
    log = promotions(spark, [("m", 0, 1), ("m", 100, 2), ("m", 100000, 1), ("n", 5, 7)])
    got = {(r.model, r.version, (r.valid_from - T0).total_seconds()): r.valid_to and (r.valid_to - T0).total_seconds() for r in L.alias_timeline(log).collect()}
    assert got == {("m", 1, 0.0): 100.0, ("m", 2, 100.0): 100000.0, ("m", 1, 100000.0): None, ("n", 7, 5.0): None}
    events = spark.createDataFrame([(i, m, at(s)) for i, (m, s) in enumerate([("m", -1), ("m", 0), ("m", 99), ("m", 100), ("m", 200000), ("x", 5), ("n", 50)])], "id INT, model STRING, ts TIMESTAMP")
    got = {r.id: r.serving_version for r in L.serving_version_as_of(events, log).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 2, 4: 1, 5: None, 6: 7}


def test_promotion_target_is_numeric(spark):
    df = spark.createDataFrame([("m", "9"), ("m", "10")], "model STRING, version STRING")
    assert L.promotion_target(df).first().version == 10


def run_ticks(spark, counts, ticks, baseline=None, **options):
    corrections = spark.createDataFrame([("m", at(s)) for s, n in counts for _ in range(n)], "model STRING, corrected_at TIMESTAMP")
    rows = spark.createDataFrame([("m", at(s), ok, forced) for s, ok, forced in ticks], "model STRING, ts TIMESTAMP, pipeline_ok BOOLEAN, forced BOOLEAN")
    base = spark.createDataFrame([("m", baseline)], "model STRING, baseline BIGINT") if baseline is not None else None
    return L.retrain_decisions(corrections, rows, base, **options).orderBy("ts").collect()


def test_first_trigger_and_too_recent_first(spark):
    got = run_ticks(spark, [(0, 600), (1000, 9000)], [(10, True, False), (3610, True, False)], baseline=10)
    assert [(r.decision, r.correction_delta, r.hours_since_last) for r in got] == [("triggered", 590, 1e9), ("skipped_too_recent", 9000, 1.0)]


def test_state_rules(spark):
    day = 86400
    counts = [(0, 100), (day, 600), (2 * day + 100, 499), (3 * day, 1)]
    ticks = [(5, True, False), (day + 5, False, False), (day + 60, True, False), (2 * day + 30, True, True), (2 * day + 200, True, False), (3 * day + 5, True, False)]
    got = [(r.decision, r.correction_delta) for r in run_ticks(spark, counts, ticks)]
    assert got == [
        ("skipped_insufficient_corrections", 0),  # baseline is the count at the start
        ("triggered", 600),  # fails: state stays
        ("triggered", 600),
        ("triggered", 700),  # forced: no state
        ("skipped_insufficient_corrections", 499),
        ("triggered", 500),
    ]


def test_random_ticks_equal_a_sequential_replay(spark):
    rng = random.Random(9)
    counts = [(rng.randrange(10 * 86400), rng.randrange(1, 4)) for _ in range(500)]
    ticks = sorted({(rng.randrange(10 * 86400), rng.random() < 0.7, False) for _ in range(150)})
    want, last, base = [], None, 0
    for s, ok, _ in ticks:
        count = sum(n for t, n in counts if t <= s)
        hours = 1e9 if last is None else (s - last) / 3600
        delta = count - base
        decision = "skipped_too_recent" if hours < 24 else "skipped_insufficient_corrections" if delta < 80 else "triggered"
        if decision == "triggered" and ok:
            last, base = s, count
        want.append((decision, delta))
    got = run_ticks(spark, counts, ticks, baseline=0, min_corrections=80)
    assert [(r.decision, r.correction_delta) for r in got] == want
