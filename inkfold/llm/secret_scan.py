"""Secret scans with multipart credential linking.

Strong spans (assignments of a secret, access ids, long hex runs) count by themselves. Weak candidates (random-looking
tokens, account names, endpoints) are common in clean text and count only as parts of one credential: an interval join
of the parts of a document finds, for each weak one, the complementary parts with at most ``SCOPE`` code points between
the two (from the end of one to the start of the other, so lengths do not matter); it is
reported if a strong part of another class is there, or weak parts of both other classes are.

Only DataFrame functions. Matches have no positions in SQL, so the text is split by the pattern: the lengths of what
lies between the matches, summed up, are the starts. Matches become rows, the text does not; the interval join is
running counts over the starts and ends of a document, so no pairs are built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.llm.common import keyed_texts, sha256_hex, table, whole_text

# Base patterns and least lengths of the contract (fixed values).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
ACCOUNT = r"""(?i:client_?id|user_?name|account_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ACCOUNT_WORDS = ("clientid", "client_id", "username", "user_name", "accountid", "account_id", "login")
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}"""
SCOPE = 200
DOC = ("row", "doc_id", "text_key")
KINDS = ("assign", "access", "hex", "token", "account", "endpoint")
# Class of each kind, and whether it is strong.
PARTS = {"assign": ("secret", True), "access": ("id", True), "hex": ("secret", True), "token": ("secret", False), "account": ("id", False), "endpoint": ("endpoint", False)}
CLASSES = ("id", "secret", "endpoint")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.lit(1), text)


def _matches(kind: str, pattern: str, present: Column, value_group: int | None = None) -> Column:
    """Matches of a pattern as an array of (kind, place in order, length of the text before it since the last match, own
    length, ok). The pattern runs only where ``present`` holds, a cheap test that every match passes."""
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if value_group is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"), values.alias("value"))
    else:
        rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))

    def row(x: Column, i: Column) -> Column:
        if kind == "assign":
            ok = F.char_length(x["value"]) >= LEAST_VALUE
        elif kind == "token":
            ok = x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Z]") & x["hit"].rlike("[a-z]") & ~x["hit"].rlike(HEX)
        else:
            ok = F.lit(True)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.char_length(x["gap"]).cast("bigint").alias("gap"),
            F.char_length(x["hit"]).cast("bigint").alias("long"), ok.alias("ok"),
        )

    none = F.array().cast("array<struct<kind:int,nth:int,gap:bigint,long:bigint,ok:boolean>>")
    return F.when(present, F.transform(rows, row)).otherwise(none)


def secret_spans(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): ``spans``, an array of (start, kind number, name, end) by start, then
    kind (code points, end exclusive), and ``text_key``, a hash of the text.

    Null and empty texts have no spans. Texts are scanned whole; repeated rows and ids keep their own rows. Other
    columns are ignored. All spans of one document meet in one task, never those of several under one key."""
    docs = keyed_texts(df).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text_key(F.col("text")).alias("text_key"), "text",
        F.lower("text").alias("low"),
    )

    def any_of(words) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains("low", F.lit(w))
        return out

    marked = docs.select(
        *DOC, "text", any_of(ASSIGN_WORDS).alias("assign"), any_of(ACCOUNT_WORDS).alias("account"),
        F.contains("text", F.lit("AKIA")).alias("access"), F.contains("text", F.lit("://")).alias("endpoint"),
        F.col("text").rlike(HEX).alias("hex"),
    )
    # A weak token needs an id beside it, or an endpoint and an account.
    tokens = F.col("access") | F.col("account")
    matched = marked.select(
        *DOC,
        F.concat(
            _matches("assign", ASSIGN, F.col("assign"), 2),
            _matches("access", ACCESS, F.col("access")),
            _matches("hex", HEX, F.col("hex")),
            _matches("token", TOKEN, tokens),
            _matches("account", ACCOUNT, F.col("account")),
            _matches("endpoint", ENDPOINT, F.col("endpoint")),
        ).alias("found"),
    )
    rows = matched.select(*DOC, F.explode_outer("found").alias("m")).select(*DOC, "m.*").repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("long")).over(so_far)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("long"))
    # What fails stays as a row without a span, so that every document keeps a row.
    ok = F.coalesce("ok", F.lit(False))
    placed = placed.select(*DOC, *[F.when(ok, F.col(c)).alias(c) for c in ("kind", "start", "end")])

    kinds = {c: [KINDS.index(k) for k in KINDS if PARTS[k][0] == c] for c in CLASSES}
    strong = [KINDS.index(k) for k in KINDS if PARTS[k][1]]
    ordered = Window.partitionBy("row").orderBy("start", "kind")
    covered = F.max(F.when(F.col("kind").isin(strong), F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    inside = F.col("kind").isin([KINDS.index("token")]) & (F.coalesce(covered, F.lit(0)) > F.col("start"))
    placed = placed.withColumn("inside", F.coalesce(inside, F.lit(False))).select(
        *DOC, *[F.when(~F.col("inside"), F.col(c)).alias(c) for c in ("kind", "start", "end")]
    )
    # Linked are the parts that start up to SCOPE behind the own end, less those that end more than SCOPE before the own
    # start: two running counts over one start and one end event per part, so a part of any length reaches both ways.
    is_end = F.col("is_end")
    events = placed.select(*DOC, "kind", "start", "end", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_end"))
    events = events.withColumn("at", F.when(is_end, F.col("end")).otherwise(F.col("start")))
    along = Window.partitionBy("row").orderBy("at")
    begun = along.rangeBetween(Window.unboundedPreceding, SCOPE)
    over = along.rangeBetween(Window.unboundedPreceding, -SCOPE - 1)

    def linked_parts(members: list[int]) -> Column:
        """At the end event the parts begun, at the start event those over, as a negative number."""
        mine = F.col("kind").isin(members)
        n_begun = F.sum(F.when(mine & ~is_end, 1).otherwise(0)).over(begun)
        n_over = F.sum(F.when(mine & is_end, 1).otherwise(0)).over(over)
        return F.when(is_end, F.coalesce(n_begun, F.lit(0))).otherwise(-F.coalesce(n_over, F.lit(0)))

    groups = {f"any_{c}": kinds[c] for c in CLASSES} | {f"strong_{c}": [k for k in kinds[c] if k in strong] for c in CLASSES}
    counted = events.select(*DOC, "kind", "start", "end", *[linked_parts(ks).alias(g) for g, ks in groups.items()])
    # Matches of one kind never overlap: start and kind name a part.
    linked = counted.groupBy(*DOC, "kind", "start", "end").agg(*[(F.sum(g) > 0).alias(g) for g in groups])
    reported = F.col("kind").isin(strong)
    for c in CLASSES:
        others = [x for x in CLASSES if x != c]
        together = (
            F.col(f"strong_{others[0]}") | F.col(f"strong_{others[1]}") | (F.col(f"any_{others[0]}") & F.col(f"any_{others[1]}"))
        )
        reported = reported | (F.col("kind").isin(kinds[c]) & together)
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", "kind", name.alias("name"), "end")
    found = linked.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.when(reported, span))).alias("spans"))
    return found.drop("row")


def _listed(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def span_digest(spans: DataFrame) -> DataFrame:
    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        sha256_hex(_listed(base)).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


MARK = "[SECRET]"
PIECE = 4096


def mask_secrets(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with every reported span of ``text`` replaced by ``[SECRET]`` (overlapping spans by one) and
    ``n_chars`` (if there) counted anew. A null text stays null. Rows of equal id and text have equal spans, so spans are joined back by id
    and text hash; only documents with spans come from that side. A long text is cut in pieces first, so that the cost
    follows its length."""
    spans = secret_spans(df).where(F.size("spans") > 0).withColumnsRenamed({"doc_id": "span_id", "text_key": "span_key"})
    spans = spans.dropDuplicates(["span_id", "span_key"]).select("span_id", "span_key", "spans")
    mine = df.select(
        F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        text_key(whole_text()).alias("text_key"), F.col("text").cast("string").alias("text"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_key") == F.col("span_key"))
    joined = mine.join(spans, same, "left")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(piece: Column, i: Column) -> Column:
        """The piece without what spans cover; the mark stands where a span starts."""
        low, high = i * PIECE, (i + 1) * PIECE
        here = F.filter("spans", lambda s: (s["start"] < high) & (s["end"] > low))
        state = F.struct(F.lit("").alias("out"), low.cast("bigint").alias("at"))

        def step(acc: Column, s: Column) -> Column:
            before = F.substring(piece, (acc["at"] - low + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            mark = F.when((s["start"] >= low) & (s["start"] >= acc["at"]), F.lit(MARK)).otherwise(F.lit(""))
            return F.struct(F.concat(acc["out"], before, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        def finish(acc: Column) -> Column:
            return F.concat(acc["out"], F.substring(piece, F.least(acc["at"] - low + 1, F.lit(PIECE + 1)).cast("int"), F.lit(PIECE)))

        return F.aggregate(here, state, step, finish)

    masked = joined.select(
        "row", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(F.transform(pieces, cut), "")).alias("text"),
        F.col("spans").isNotNull().alias("changed"),
    )
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in df.columns:
        n = F.when(F.col("changed"), F.char_length("text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", n)
    return masked.select(row.alias("row")).select("row.*")


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return span_digest(secret_spans(table(spark, folder, "documents")))


def secret_sql() -> str:
    """The scan in DuckDB SQL: positions from split lengths, and the interval join as a join on the gap between two parts."""

    def plain(pattern: str) -> str:
        """Letters of ``(?i:...)`` in either ASCII case, as an SQL string."""
        out, i = "", 0
        while i < len(pattern):
            if pattern.startswith("(?i:", i):
                end = pattern.index(")", i)
                out += "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern[i + 4 : end]) + ")"
                i = end + 1
            else:
                out += pattern[i]
                i += 1
        return "'" + out.replace("'", "''") + "'"

    patterns = [ASSIGN, ACCESS, HEX, TOKEN, ACCOUNT, ENDPOINT]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, string_split_regex(text, {plain(p)}) AS gaps, regexp_extract_all(text, {plain(p)}, 0) AS hits, "
        f"regexp_extract_all(text, {plain(p)}, {2 if k == 0 else 0}) AS vals FROM d"
        for k, p in enumerate(patterns)
    )
    strong = ", ".join(str(k) for k, name in enumerate(KINDS) if PARTS[name][1])
    members = {c: [k for k, name in enumerate(KINDS) if PARTS[name][0] == c] for c in CLASSES}
    flags = ", ".join(
        f"bool_or(o.kind IN ({', '.join(map(str, ks))})) AS any_{c}, "
        f"bool_or(o.kind IN ({', '.join(map(str, ks))}) AND o.kind IN ({strong})) AS strong_{c}"
        for c, ks in members.items()
    )
    linked = " OR ".join(
        f"(kind IN ({', '.join(map(str, members[c]))}) AND (strong_{a} OR strong_{b} OR (any_{a} AND any_{b})))"
        for c in CLASSES
        for a, b in [[x for x in CLASSES if x != c]]
    )
    names = "[" + ", ".join(f"'{n}'" for n in KINDS) + "]"
    one = f"({names})[kind + 1] || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, kind, i, length(gaps[i]) AS gap, hits[i] AS hit, vals[i] AS val
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({found}))),
pos AS (SELECT *, sum(gap + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
p AS (SELECT doc_id, kind, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM pos
      WHERE CASE kind WHEN 0 THEN length(val) >= {LEAST_VALUE}
                      WHEN 3 THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND NOT regexp_matches(hit, '{HEX}')
                      ELSE true END),
q AS (SELECT * FROM (SELECT *, max(CASE WHEN kind IN ({strong}) THEN e END) OVER (PARTITION BY doc_id ORDER BY s, kind ROWS UNBOUNDED PRECEDING) AS covered FROM p)
      WHERE NOT (kind = 3 AND coalesce(covered, 0) > s)),
r AS (SELECT q.doc_id, q.kind, q.s, q.e, {flags} FROM q JOIN q o ON o.doc_id = q.doc_id AND o.s <= q.e + {SCOPE} AND o.e >= q.s - {SCOPE}
      GROUP BY q.doc_id, q.kind, q.s, q.e),
k AS (SELECT doc_id, kind, s, e FROM r WHERE kind IN ({strong}) OR {linked})
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg({one}, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY s, kind) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""


OP8_SQL = secret_sql()
