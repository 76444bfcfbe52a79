"""URL filters: all wildcard rules at once, as one bit-parallel automaton.

Every glob is laid out as one bit per literal or ``?`` in a row of 64-bit words (Shift-And). One step per URL byte
advances every rule for every URL of an Arrow batch: shift, carry into the next word, and with the byte's mask; a star
is a bit that holds its state while its bytes last. Rules are matched against ``.host/path``:

* ``**`` any bytes, ``*`` any bytes but ``/``, ``?`` one byte but ``/``; all else stands for itself."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm.common import table

SLASH = ord("/")

# Host and path rules of the contract (fixed values).
BASE_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# What the method itself judges where no base rule fits: glob -> verdict; else "allow".
GLOB_RULES = {
    "**ads-track**": "block",
    "*.doubleclick.*/**": "block",
    "*.ads.*/**": "block",
    "**/banner/**": "block",
    "**/track?.gif": "block",
    "**.exe": "block",
}


@dataclass(frozen=True)
class Automaton:
    """Masks of all rules; ``steps[b]`` has the bits that byte ``b`` may enter, ``hold_*`` the bits that stay."""

    steps: np.ndarray
    first: np.ndarray
    hold_any: np.ndarray
    hold_segment: np.ndarray
    open_start: np.ndarray
    last: np.ndarray
    last_word: np.ndarray
    last_bit: np.ndarray


def compile_globs(globs: Sequence[str]) -> Automaton:
    """Bit 0 of each rule is its start state; each literal byte or ``?`` takes the next bit."""
    literals: list[tuple[int, int | None]] = []
    first, holds_any, holds_segment, last = [], [], [], []
    bit = 0
    for glob in globs:
        first.append(bit)
        raw, i = glob.encode("utf-8"), 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                holds_any.append(bit)
                i += 2
            elif raw[i] == ord("*"):
                holds_segment.append(bit)
                i += 1
            else:
                bit += 1
                literals.append((bit, None if raw[i] == ord("?") else raw[i]))
                i += 1
        last.append(bit)
        bit += 1
    words = max(1, -(-bit // 64))

    def mask(bits) -> np.ndarray:
        out = np.zeros(words, dtype=np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    steps = np.zeros((256, words), dtype=np.uint64)
    for b, byte in literals:
        one = mask([b])
        if byte is None:
            steps[[x for x in range(256) if x != SLASH]] |= one
        else:
            steps[byte] |= one
    return Automaton(
        steps, mask(first), mask(holds_any), mask(holds_segment), mask(first), mask(last),
        np.array(last, dtype=np.int64) // 64, np.array(last, dtype=np.uint64) % np.uint64(64),
    )


def match_globs(auto: Automaton, texts: Sequence[str]) -> np.ndarray:
    """Boolean matrix (texts x rules): the rule matches the whole text."""
    raw = [t.encode("utf-8") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    buffer = np.frombuffer(b"".join(raw) + b"\0", dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[order] if len(raw) else sizes
    longest_first = sizes[order]
    state = np.tile(auto.open_start, (len(raw), 1))
    one, top = np.uint64(1), np.uint64(63)
    live = len(raw)
    for step in range(int(sizes.max(initial=0))):
        while live and longest_first[live - 1] <= step:
            live -= 1
        byte = buffer[starts[:live] + step]
        now = state[:live]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        held = now & np.where((byte == SLASH)[:, None], auto.hold_any, auto.hold_any | auto.hold_segment)
        state[:live] = (moved & auto.steps[byte]) | held
    out = np.zeros((len(raw), len(auto.last_word)), dtype=bool)
    if len(raw):
        out[order] = (state[:, auto.last_word] >> auto.last_bit) & one != 0
    return out


def host_and_path(url: str = "url") -> tuple:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased) and path (up to ``?`` or ``#``).
    Null, or no ``://``: both empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def rule_glob(rule: str) -> str:
    """Glob over ``.host/path`` of a host/path rule: the host and its subdomains, any path that starts alike."""
    host, _, path = rule.partition("/")
    return f"*.{host}/{path}**"


def judge_urls(df: DataFrame, key: str, base_rules: dict[str, str], glob_rules: dict[str, str]) -> DataFrame:
    """One row per row of ``df``: key, host, path, the longest base rule that fits (else null) and the verdict: the
    rule's; else block if a blocking glob fits, else allow.

    Null, empty or malformed urls have an empty host and path, no rule, and verdict allow. Urls of any length are read
    whole; repeated rows are judged each; other columns are ignored. No shuffle: each batch stands alone. Literal
    ``*`` and ``?`` cannot be written in a rule."""
    rules = sorted(base_rules, key=lambda r: (-len(r), r))
    globs = list(glob_rules)
    auto = compile_globs([rule_glob(r) for r in rules] + globs)
    blocking = np.array([glob_rules[g] == "block" for g in globs], dtype=bool)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = match_globs(auto, ("." + batch["host"] + batch["path"]).tolist())
            base, own = hits[:, : len(rules)], hits[:, len(rules) :]
            found = base.any(axis=1)
            which = base.argmax(axis=1) if rules else np.zeros(len(batch), dtype=int)
            rule = [rules[w] if f else None for w, f in zip(which, found, strict=True)]
            block = (own & blocking).any(axis=1)
            fits = [globs[o.argmax()] if o.any() else None for o in own]
            verdict = [base_rules[r] if r else ("block" if b else "allow") for r, b in zip(rule, block, strict=True)]
            yield batch.assign(rule=rule, verdict=verdict, fit=fits)[["key", "host", "path", "rule", "verdict", "fit"]]

    host, path = host_and_path()
    rows = df.select(F.col(key).cast("bigint").alias("key"), host.alias("host"), path.alias("path"))
    out = rows.mapInPandas(judge, "key bigint, host string, path string, rule string, verdict string, fit string")
    return out.withColumnRenamed("key", key)


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), "page_id", BASE_RULES, GLOB_RULES)


OP5_SQL = r"""
WITH rest AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^?#]*)', 1) AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/]*(.*)$', 1) AS path FROM rest
), judged AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
         CASE WHEN contains('.' || host || path, 'ads-track') THEN '**ads-track**'
              WHEN regexp_matches('.' || host || path, '(?s)^[^/]*\.doubleclick\.[^/]*/.*$') THEN '*.doubleclick.*/**'
              WHEN regexp_matches('.' || host || path, '(?s)^[^/]*\.ads\.[^/]*/.*$') THEN '*.ads.*/**'
              WHEN contains('.' || host || path, '/banner/') THEN '**/banner/**'
              WHEN regexp_matches('.' || host || path, '(?s)^.*/track[^/]\.gif$') THEN '**/track?.gif'
              WHEN suffix('.' || host || path, '.exe') THEN '**.exe' END AS fit
  FROM parts)
SELECT page_id, host, path, rule, fit,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                 WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN fit IS NULL THEN 'allow' ELSE 'block' END END AS verdict
FROM judged"""
