import re

from check import connect, rows
from inkfold.llm.license_scan import BASE_PHRASES, NOTICES, OP4_SQL, SHARE, STRIDE, WINDOW, WORD, op4_license_scan, scan_licenses, templates

WORDS = re.compile(WORD)


def brute(doc_id, text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, base, labels, score = [], set(), set(), 0.0
    for t in templates(BASE_PHRASES, NOTICES, SHARE):
        n = len(t.words)
        if t.base:
            found = [i for i in range(len(w)) if tuple(w[i : i + n]) == t.words]
            places += found
            if found:
                base.add(t.label)
                labels.add(t.label)
                score = 1.0
            continue
        want = set(t.words)
        for k in range(0, max(len(w), 1), STRIDE):
            part = len(want & set(w[k : k + WINDOW])) / len(want)
            if part * len(want) >= t.needed:
                labels.add(t.label)
                score = max(score, part)
    first, last = (min(places), max(places)) if places else (None, None)
    return (doc_id, len(w), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score)


HARD = [
    None, "", "!!!", "MIT License", "mit\n\nlicense MIT-LICENSE mitlicense", "x " * 15 + "gnu general public license " * 3,
    "y " * 31 + "CC BY cc by", "under the terms of gnu lesser general license", "the GNU General Public License, " * 400,
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "w " * 5000 + "Apache License é Apache_License",
    "gnu general public gnu general public license license", "granted free charge any person obtaining copy hereby permission to of a",
]


def check(df, rows_):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in scan_licenses(df).collect()), key=key) == sorted((brute(*r) for r in rows_), key=key)


def test_equals_brute_force(spark):
    data = list(enumerate(HARD)) + [(3, "MIT License"), (None, "cc by"), (None, "cc by")]
    check(spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 AS row", "'x' AS words", "2 AS token"), data)
    assert scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(df, [tuple(r) for r in df.select("doc_id", "text").collect()])


def test_query_equals_sql(spark, sf):
    assert rows(op4_license_scan(spark, sf).toPandas()) == rows(connect(sf).execute(OP4_SQL).df())
