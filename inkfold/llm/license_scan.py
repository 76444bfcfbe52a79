"""License scans as an exact set-similarity join of text blocks with notice templates.

Text is cut into overlapping blocks of words. A block meets a template if it holds at least the template's share of its
distinct words (containment). Words are ordered by how many documents have them, rarest first, counted over the corpus;
a block can only meet a template if it has one of the template's first ``n - needed + 1`` words (prefix filter), if it
has enough template words at all (length filter), and if enough words follow the first common one on both sides
(positional filter). What is left is verified. The filters lose nothing. Base phrases are templates that need all their
words and are then located word by word.

Only DataFrame functions; the text is scanned in place and only candidate blocks become rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm.common import keyed_texts, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Phrases and labels of the contract (fixed values).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices the method looks for itself, and the least share of a notice's distinct words.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-text",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "redistribution and use in source and binary forms are permitted": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
SHARE = 0.8
WINDOW, STRIDE = 32, 16


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    base: bool
    needed: int


def templates(phrases: dict[str, str], notices: dict[str, str], share: float) -> list[Template]:
    out = []
    for base, texts in ((True, phrases), (False, notices)):
        for text, label in texts.items():
            words = tuple(text.split())
            if not 0 < len(words) <= WINDOW - STRIDE + 1:
                raise ValueError(f"a template has 1 to {WINDOW - STRIDE + 1} words: {text!r}")
            n = len(set(words))
            out.append(Template(len(out), label, words, base, n if base else max(1, ceil(share * n - 1e-9))))
    return out


def lower_words(text: Column) -> Column:
    """Words with A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def word_order(docs: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The template words, rarest first by document count over the whole corpus; ties by the word. At most one row per
    template word reaches the driver."""
    found = F.array_distinct(F.filter(lower_words(F.col("text")), lambda w: w.isin(list(vocabulary))))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = {r["word"]: r["n"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def scan_licenses(
    df: DataFrame, phrases: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES, share: float = SHARE
) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): n_words, n_base (all phrase places), first_word / last_word (their
    smallest and largest start), base_labels, labels, score (largest share of a template met; 1 for a phrase place).

    Null and empty texts have no words, no labels and score 0. Repeated rows and repeated ids keep their own rows.
    Other columns are ignored. A long text is scanned whole; its candidate blocks hold at most twice its words."""
    known = templates(phrases, notices, share)
    docs = keyed_texts(df)
    order = word_order(docs, sorted({w for t in known for w in t.words}))
    rank = {w: i for i, w in enumerate(order)}
    ranked = {t.number: sorted({rank[w] for w in t.words}) for t in known}
    rows, prefix = [], set()
    for t in known:
        mine = ranked[t.number]
        for at, r in enumerate(mine[: len(mine) - t.needed + 1]):
            prefix.add(order[r])
            rows.append((r, t.number, t.label, t.base, list(t.words), mine, at, t.needed))
    # As many rows as the templates have prefix words.
    entries = F.broadcast(
        df.sparkSession.createDataFrame(
            rows, "token int, number int, label string, base boolean, phrase array<string>, ranks array<int>, at int, needed int"
        )
    )

    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lower_words(F.col("text")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(prefix)), i)), lambda i: i.isNotNull())

    def blocks_of(i: Column) -> Column:
        newest = F.floor(i / STRIDE).cast("int")
        return F.sequence(F.greatest(newest - (WINDOW // STRIDE - 1), F.lit(0)), newest)

    placed = words.select("row", "doc_id", "words", hits.alias("hits")).select(
        "row",
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.transform(
            F.array_distinct(F.flatten(F.transform("hits", blocks_of))),
            lambda k: F.struct(k.alias("k"), F.slice("words", k * STRIDE + 1, F.lit(WINDOW)).alias("block")),
        ).alias("blocks"),
    )
    blocks = placed.select("row", "doc_id", "n_words", F.explode_outer("blocks").alias("b")).select(
        "row", "doc_id", "n_words", F.col("b.k").alias("k"), F.col("b.block").alias("block")
    )
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    known_words = F.filter("block", lambda w: w.isin(order))
    tokens = F.array_sort(F.array_distinct(F.transform(known_words, lambda w: F.element_at(ranks, w))))
    tokened = blocks.withColumn("tokens", tokens)
    candidates = tokened.select("*", F.posexplode_outer("tokens").alias("pos", "token")).join(entries, "token", "left")
    common = F.array_intersect("tokens", "ranks")
    long_enough = F.size("tokens") >= F.col("needed")
    follows = F.least(F.size("tokens") - F.col("pos"), F.size("ranks") - F.col("at")) >= F.col("needed")
    first_common = F.get(common, F.lit(0)) == F.col("token")
    met = long_enough & follows & first_common & (F.size(common) >= F.col("needed"))
    starts = F.filter(
        F.sequence(F.lit(0), F.least(F.lit(STRIDE), F.size("block")) - 1),
        lambda j: F.slice("block", j + 1, F.size("phrase")) == F.col("phrase"),
    )
    judged = candidates.select(
        "row", "doc_id", "n_words", "label", "base", "k",
        F.coalesce(met, F.lit(False)).alias("met"),
        (F.size(common) / F.size("ranks")).alias("part"),
        F.when(met & F.col("base"), starts).alias("starts"),
    )
    place = F.col("met") & F.col("base") & (F.size("starts") > 0)
    own = F.col("met") & ~F.col("base")
    first = F.col("k") * STRIDE + F.get("starts", F.lit(0))
    last = F.col("k") * STRIDE + F.element_at("starts", -1)
    return (
        judged.groupBy("row", "doc_id", "n_words")
        .agg(
            F.coalesce(F.sum(F.when(place, F.size("starts"))), F.lit(0)).cast("bigint").alias("n_base"),
            F.min(F.when(place, first)).cast("bigint").alias("first_word"),
            F.max(F.when(place, last)).cast("bigint").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(place | own, F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(place, F.lit(1.0)).when(own, F.col("part"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def license_sql() -> str:
    """Brute force: every block against every template, and every word place against every phrase."""
    known = templates(BASE_PHRASES, NOTICES, SHARE)

    def listed(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    rows = ", ".join(f"('{t.label}', {str(t.base).lower()}, {listed(t.words)}, {listed(sorted(set(t.words)))}, {t.needed})" for t in known)
    return rf"""
WITH t(label, base, phrase, distinct_words, needed) AS (VALUES {rows}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents
), blocks AS (
  SELECT doc_id, w[k * {STRIDE} + 1 : k * {STRIDE} + {WINDOW}] AS b
  FROM (SELECT doc_id, w, unnest(range((len(w) + {STRIDE} - 1) // {STRIDE})) AS k FROM d)
), own AS (
  SELECT doc_id, label, max(len(list_intersect(b, distinct_words)) / len(distinct_words)) AS part
  FROM blocks, t WHERE NOT base AND len(list_intersect(b, distinct_words)) >= needed GROUP BY doc_id, label
), places AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d), t
  WHERE base AND w[i + 1] = phrase[1] AND w[i + 1 : i + len(phrase)] = phrase
), p AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id
), l AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score
  FROM (SELECT doc_id, label, part FROM own UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)"""


OP4_SQL = license_sql()
