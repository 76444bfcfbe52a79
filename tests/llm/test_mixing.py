import pytest

from check import connect, rows
from inkfold.llm.mixing import OP7_SQL, entropy_rates, mix_sources, op7_mixing, take_copies


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, size string, copies int")


def targets(sizes):
    """Water filling as the contract words it: give all, cap, share the excess out again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        for s in free:
            out[s] += share * weight[s]
        left = sum(max(0.0, out[s] - 3 * sizes[s]) for s in free)
        free = {s for s in free if out[s] < 3 * sizes[s]}
        out = {s: min(out[s], 3.0 * sizes[s]) for s in names}
    return out


def test_targets_and_rounding(spark):
    data = [(i, " ".join(["w"] * (i % 17)), ["b", "a", None, "", "é"][i % 5 if i % 3 else 0], "x", 1) for i in range(400)]
    data += [(7, "same text", "b", "x", 1)] * 5 + [(None, "no id here", "a", "x", 1), (900, None, "b", "x", 1), (901, "only one", "z", "x", 1)]
    df = frame(spark, data)
    out = mix_sources(df).toPandas()
    assert len(out) == len(data)
    sizes = {}
    for _, text, source, _, _ in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for source, target in want.items():
        mine = out[out.skey == ("1" if source is None else "0" + source)]
        assert mine.target.iloc[0] == pytest.approx(target) and mine.source_size.iloc[0] == sizes[source]
        assert abs(mine.taken.sum() - target) <= max(3, 17)
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    again = mix_sources(df.repartition(7)).toPandas()
    assert rows(again) == rows(out)
    taken = take_copies(df, mix_sources(df))
    assert taken.columns == df.columns and taken.count() == out.copies.sum()


def test_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 20.0), ("b", "y", 40.0)], "s string, l string, tokens double")
    by_s = spark.createDataFrame([("a", 60.0), ("b", 40.0)], "s string, target double")
    by_l = spark.createDataFrame([("x", 30.0), ("y", 70.0)], "l string, target double")
    got = entropy_rates(cells, {"s": by_s, "l": by_l}).toPandas()
    got["t"] = got.tokens * got.rate
    assert got.groupby("s").t.sum().to_dict() == pytest.approx({"a": 60, "b": 40}) and got.groupby("l").t.sum().to_dict() == pytest.approx({"x": 30, "y": 70})
    # Exponential tilt: the interaction of the rates is none.
    r = got.set_index(["s", "l"]).rate
    assert r["a", "x"] * r["b", "y"] == pytest.approx(r["a", "y"] * r["b", "x"])


def test_empty_and_wordless(spark):
    assert mix_sources(frame(spark, [])).count() == 0
    out = mix_sources(frame(spark, [(1, "", "a", "x", 1), (2, None, None, "x", 1)])).collect()
    assert [r.taken for r in out] == [0, 0] and [r.target for r in out] == [0.0, 0.0]


def test_query_equals_sql(spark, sf):
    assert rows(op7_mixing(spark, sf).toPandas()) == rows(connect(sf).execute(OP7_SQL).df())
