import re

from hypothesis import given, settings
from hypothesis import strategies as st

from check import connect, rows
from inkfold.llm.url_filter import BASE_RULES, GLOB_RULES, OP5_SQL, compile_globs, judge_urls, match_globs, op5_url_filter


def as_regex(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts), re.DOTALL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/?*", max_size=30), min_size=1, max_size=8), st.lists(st.text("ab/c", max_size=12), max_size=8))
def test_globs_equal_regex(globs, texts):
    globs = [g.replace("***", "**") for g in globs]
    got = match_globs(compile_globs(globs), texts)
    assert got.tolist() == [[as_regex(g).fullmatch(t) is not None for g in globs] for t in texts]


def test_many_rules_span_words():
    globs = [f"*.host{i}.example/**" for i in range(60)]
    got = match_globs(compile_globs(globs), [f".a.host{i}.example/x" for i in range(60)] + ["." + "q" * 100000])
    assert got[:60].tolist() == [[i == j for j in range(60)] for i in range(60)] and not got[60].any()


def test_hard_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://net", "http://net/", "http://x.org/fr/", "http://xorg/fr/",
            "http://example.com/de/?a://b", "http://u@example.net:80/en/", "http://a/" + "z" * 50000 + "ads-track", "http://e.net?x/", "http://é.net/é"]
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)] + [(2, "x", "r", "v")], "page_id bigint, url string, rule string, host string")
    got = {r.page_id: r for r in judge_urls(df, "page_id", BASE_RULES, GLOB_RULES).where("page_id <> 2").collect()}
    assert [(got[i].host, got[i].path, got[i].verdict) for i in (0, 1, 3)] == [("", "", "allow")] * 3
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert [got[i].rule for i in (5, 6, 7, 8, 9, 10, 12, 13)] == [None, "net/", "org/fr/", None, "example.com/de/", None, None, "net/"]
    assert got[11].verdict == "block" and judge_urls(df.limit(0), "page_id", BASE_RULES, GLOB_RULES).count() == 0


def test_query_equals_sql(spark, sf):
    assert rows(op5_url_filter(spark, sf).toPandas()) == rows(connect(sf).execute(OP5_SQL).df())
