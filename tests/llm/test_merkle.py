import hashlib

import pytest
from pyspark.sql import functions as F

from check import connect, rows
from inkfold.llm import merkle as M

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, pos int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    fields = [doc_id, source, lang, n_chars, text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def proof_of(levels, i):
    """Siblings level by level, and the way to fold them."""
    out = []
    for level in levels[:-1]:
        start = i - i % 3
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 3])))
        i //= 3
    return out


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def expected(data, claimed):
    trees = {}
    for row in data:
        trees.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(row), leaf((row[0], claimed(row), *row[2:]))))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s])]) for s in sources}
    top = levels_of([built[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (known, doc_id, own, claim) in enumerate(sorted(trees[s])):
            steps = proof_of(built[s], i) + proof_of(top, k)
            node = claim
            for a, b in steps:
                node = H(a, node, b)
            sibs = "".join(a + b for a, b in steps)
            out.append((doc_id if known else None, own, built[s][-1][0], top[-1][0], H(sibs), node, node == top[-1][0]))
    return sorted(map(str, out))


def sample(sizes):
    data = []
    for source, n in sizes.items():
        data += [(i * 3 % 1000 + 7 * i, f"té\n{i}" if i % 4 else None, None if i % 5 == 0 else "en", source, i, "x", 0) for i in range(n)]
    return data


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 1}, {None: 2, "": 5, "b": 81, "c": 82}, {"a": 250, "b": 1, None: 28, "ü": 244}])
def test_equals_plain_trees(spark, tmp_path, sizes):
    data = sample(sizes)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    text = F.when(F.col("n_chars") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = M.verify_rows(df, text, str(tmp_path / "m"))
    want = expected(data, lambda r: r[1].replace("\n", "") if r[1] is not None and r[4] % 2 == 0 else r[1])
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_repeats_null_ids_and_many_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 50)
    data = [(None, "x", None, "a", None, "", 0)] * 3 + [(5, "y", "en", "a", 1, "", 0)] * 1500 + [(5, "z" * 100_000, "en", "a", 1, "", 0)]
    data += [(i, "", "de", f"s{i}", 0, "", 0) for i in range(100)]
    got = M.verify_rows(spark.createDataFrame(data, SCHEMA), F.col("text"), str(tmp_path / "m"))
    out = sorted(str(tuple(r)) for r in got.collect())
    assert out == expected(data, lambda r: r[1])
    assert all(x.endswith("True)") for x in out)


def test_stored_levels(spark, tmp_path):
    rows_ = spark.createDataFrame(sample({"a": 250}), SCHEMA).select(
        M.source_order(F.col("source")).alias("tree"), "doc_id", M.leaf_digest().alias("digest"), M.leaf_digest().alias("claim")
    )
    forest, top = M.build_manifest(rows_, str(tmp_path / "m"))
    # 250 leaves, 4 nodes four levels up, one at the top: levels 1 to 3 are not stored.
    assert [x.count() for x in forest] == [250, 4, 1] and [x.count() for x in top] == [1]


def test_empty(spark, tmp_path):
    assert M.verify_rows(spark.createDataFrame([], SCHEMA), F.col("text"), str(tmp_path / "m")).count() == 0


def test_query_equals_sql(spark, sf):
    assert rows(M.op12_merkle(spark, sf).toPandas()) == rows(connect(sf).execute(M.OP12_SQL).df())
