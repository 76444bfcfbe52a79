import duckdb

from check import connect, rows
from inkfold.llm.secret_scan import OP8_SQL, mask_secrets, op8_secret_scan, secret_spans, span_digest
from tests.llm import brute

HARD = [
    None, "", "token=abc secret=token:abcdefgh password = 'hunter22'", "SECRET:token=secret=abcdefgh",
    "api_key=\"A1b2C3d4\" apikey:zzzzzz ap i_key=no", "AKIA" + "Z" * 16 + " AKIAX AKIA" + "9" * 30,
    "a" * 23 + " " + "f0" * 12 + "g" + "0" * 40, "x" * 5000 + "password=" + "q" * 4000 + " tail " * 900,
    "login: bob@x " + "aB3" * 9 + " https://h.example/x", "aB3" * 9 + " https://h.example/x nothing", "login: bob@x " + "aB3" * 9,
    "AKIA" + "B" * 16 + " then " + "aB3" * 9 + " and user_name=ann", "ſecret=abcdefgh Kelvin toKen=abcdefgh",
    # Long parts, whose starts are far from what follows right behind them, and gaps of just 200 and 201.
    "aB3" * 91 + " AKIA" + "D" * 16, "AKIA" + "D" * 16 + " " + "aB3" * 91, "https://h.example/" + "x" * 400 + " " + "aB3" * 100 + " login: bob@x",
    "aB3" * 9 + " " * 200 + "AKIA" + "E" * 16, "aB3" * 9 + " " * 201 + "AKIA" + "E" * 16,
    "passwort=abcdefgh password= password=", "é🙂 token=abcdefgh 🙂 AKIA" + "C" * 17, "token=token=token=ab",
]


def frame(spark, texts):
    rows = [(i, t, f"s{i}", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row string, kind string")


def check(df, got):
    want = sorted(brute.secret_row(r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in got.collect()) == want


def test_spans_equal_brute_force(spark):
    df = frame(spark, HARD + HARD[2:4])
    check(df, span_digest(secret_spans(df)))


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(df, span_digest(secret_spans(df)))


def test_repeated_ids_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, HARD[2]), (1, HARD[2]), (None, HARD[2]), (None, None)], "doc_id bigint, text string")
    got = span_digest(secret_spans(df))
    assert got.count() == 4 and got.where("n_assign = 1").count() == 3
    assert secret_spans(df.limit(0)).count() == 0


def masked(text):
    if text is None:
        return None
    out, at = "", 0
    for start, _, _, end in brute.all_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_masks_every_span(spark):
    df = frame(spark, HARD)
    got = {r.doc_id: r.text for r in mask_secrets(df).collect()}
    assert got == {i: masked(t) for i, t in enumerate(HARD)}
    assert mask_secrets(df).columns == df.columns


def test_query_equals_sql(spark, sf):
    assert rows(op8_secret_scan(spark, sf).toPandas()) == rows(connect(sf).execute(OP8_SQL).df())
    con = duckdb.connect()
    con.register("documents", frame(spark, HARD[:11] + HARD[12:]).toPandas())
    got = span_digest(secret_spans(frame(spark, HARD[:11] + HARD[12:]))).toPandas()
    assert rows(got) == rows(con.execute(OP8_SQL).df())


def test_long_parts_link_by_the_gap_on_both_sides(spark):
    """Parts longer than the scope, before and behind their complement, up to 200 code points between them."""
    token, url, access = "aB3" * 110, "https://h.example/" + "p" * 400, "AKIA" + "D" * 16
    texts, want = [], []
    for part, name in ((token, "token"), (url, "endpoint")):
        for gap in (1, 200, 201):
            for first, second in ((part, access), (access, part)):
                at = len(first) + gap
                spans = [(0, len(first)), (at, at + len(second))]
                kept = [s for s, text in zip(spans, (first, second), strict=True) if text is access or gap <= 200]
                texts.append(first + " " * gap + second)
                want.append([(s, name if (e - s) == len(part) else "access", e) for s, e in kept])
    # A short part inside the reach of a long one's end only, and one between two long ones.
    texts.append(token + " login: bob@x " + url)
    want.append([(0, "token", 330), (331, "account", 343), (344, "endpoint", 344 + len(url))])
    df = frame(spark, texts)
    got = {r.doc_id: [(s["start"], s["name"], s["end"]) for s in r.spans] for r in secret_spans(df).collect()}
    assert got == dict(enumerate(want))
    shown = {r.doc_id: r.text for r in mask_secrets(df).collect()}
    assert shown[0] == "[SECRET] [SECRET]" and shown[len(texts) - 1] == "[SECRET] [SECRET] [SECRET]"


def test_sql_on_the_hard_texts(spark, tmp_path):
    frame(spark, HARD).select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(op8_secret_scan(spark, str(tmp_path)).toPandas()) == rows(con.execute(OP8_SQL).df())
