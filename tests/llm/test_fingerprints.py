import hashlib
import random

import numpy as np
from inkfold.llm.fingerprints import as_text, compare_with_next, likeness, parse


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_equal_texts_and_batches_do_not_matter():
    texts = ["", "a", "ab", "aaaa" * 50, "abab" * 99, words(300, 1), words(3, 2), "é🙂" * 40, words(300, 1)]
    together = [as_text(*p) for p in parse(texts)]
    assert together == [as_text(*parse([t])[0]) for t in texts]
    assert together[5] == together[8] and len(set(together)) == len(texts) - 1


def test_shared_substring_shares_names_at_any_offset():
    body = words(400, 3)
    (ra, a), (rb, b) = parse([body, words(37, 4) + body])
    assert ra != rb and len(np.intersect1d(a, b)) > 0.9 * len(a)
    (_, c), (_, d) = parse([body, words(400, 5)])
    assert len(np.intersect1d(c, d)) < 0.1 * len(c)
    assert likeness(parse([body])[0], parse([body])[0]) == 1.0


def test_levels_shrink():
    text = words(20000, 6)
    root, names = parse([text])[0]
    assert len(names) < len(text) / 2 and root != 0


def expected(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(rows, key=key)
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = parse([text, edited, following])
        out[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(*a), as_text(*b), likeness(a, b), likeness(a, c))
    return out


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in compare_with_next(df).collect()}
    assert got == expected([tuple(r) for r in df.select("doc_id", "text").collect()])
    near = [(v[4], v[5]) for v in got.values() if v[0] > 300]
    assert np.mean([a for a, _ in near]) > 0.2 and np.median([b for _, b in near]) < 0.15


def test_nulls_ties_and_empty_table(spark):
    rows = [(None, "x" * 30), (3, None), (7, ""), (9, words(50, 7)), (12, words(50, 7))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS bucket", "2 AS hash")
    got = {r[0]: tuple(r)[1:] for r in compare_with_next(df).collect()}
    assert got == expected(rows)
    same = spark.createDataFrame([(1, "abc def")] * 40 + [(2, "q")], "doc_id bigint, text string")
    assert compare_with_next(same).count() == 41
    assert compare_with_next(df.limit(0)).count() == 0
    assert compare_with_next(df.where("doc_id = 9")).first()["near_next"] == 1.0
