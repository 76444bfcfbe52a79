import hashlib
import hmac
import re

from pyspark.sql import functions as F

from inkfold.operators import redaction as X

KEY = "a key"


def name(value):
    return hmac.new(KEY.encode(), value.encode(), hashlib.sha256).hexdigest()[:12]


def test_hmac_is_the_library_s(spark):
    df = spark.createDataFrame([("x",), ("",), ("é🙂",), (None,)], "v STRING")
    for key in ("", KEY, "k" * 100):
        got = {r.v: r.h for r in df.select("v", X.hmac_sha256(F.col("v"), key).alias("h")).collect()}
        assert got == {v: None if v is None else hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in got}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def test_checksums(spark):
    numbers = ["4111111111111111", "4111111111111112", "79927398713", "0", "5500005555555559", "378282246310005", "12345678901234567"]
    df = spark.createDataFrame([(n,) for n in numbers], "n STRING")
    assert {r.n: r.ok for r in df.select("n", X.luhn_valid(F.col("n")).alias("ok")).collect()} == {n: luhn(n) for n in numbers}
    accounts = ["GB82WEST12345698765432", "DE89370400440532013000", "DE89370400440532013001", "FR1420041010050500013M02606"]
    df = spark.createDataFrame([(a,) for a in accounts], "a STRING")
    want = {}
    for a in accounts:
        want[a] = int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1
    assert {r.a: r.ok for r in df.select("a", X.mod97_valid(F.col("a")).alias("ok")).collect()} == want


def test_texts(spark):
    texts = [
        ("mail Ann.B@Example.com and ann.b@example.com.", f"mail [email:{name('ann.b@example.com')}] and [email:{name('ann.b@example.com')}]."),
        ("card 4111 1111 1111 1111, not 4111 1111 1111 1112", f"card [card:{name('4111111111111111')}], not 4111 1111 1111 1112"),
        ("iban DE89 3704 0044 0532 0130 00 ok", f"iban [iban:{name('DE89370400440532013000')}] ok"),
        ("call +1 (743) 555-3824!", f"call [phone:{name('17435553824')}]!"),
        ("from 10.0.0.255 to 10.0.0.256 on 2024-02-30 or 2024-13-01", f"from [ip:{name('10.0.0.255')}] to 10.0.0.256 on [date:{name('2024-02-30')}] or 2024-13-01"),
        ("order 1234567 stays", "order 1234567 stays"), ("", ""), (None, None), ("x" * 200_000 + " a@b.cd", "x" * 200_000 + f" [email:{name('a@b.cd')}]"),
    ]
    df = spark.createDataFrame([(i, t, f"U{i % 2}", None) for i, (t, _) in enumerate(texts)], "id INT, query_text STRING, user_id STRING, other STRING")
    got = X.redact_personal(df, KEY).collect()
    assert {r.id: r.query_text for r in got} == {i: w for i, (_, w) in enumerate(texts)}
    assert {r.user_id for r in got} == {name("u0"), name("u1")}
    other = spark.createDataFrame([("u1 ", "text"), ("  ", "b")], "user_id STRING, corrected_text STRING")
    assert {r.user_id for r in X.redact_personal(other, KEY).collect()} == {name("u1"), None}
    assert all(not re.search(r"4111 1111 1111 1111", r.query_text or "") for r in got)
