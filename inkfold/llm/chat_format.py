"""Chat formatting with schema fingerprints.

A record is a JSON text of unknown layout. Those of its nested field paths (lists as ``[]``) that any layout knows, sorted and
hashed, are its fingerprint; a declarative table maps fingerprints to the fields that hold the turns. So new layouts are new
table entries, not new code, and further fields (an id, a name, metadata) do not hide a layout. Canonical turns go through one template:

    user       [INST] text [/INST]
    assistant  text</s>
    system     <<SYS>>text<</SYS>>
    others     [ROLE]role[/ROLE]text</s>

Control strings inside texts and roles are broken up by a backslash after their first character, and every backslash is
doubled, so the formatted text reads back to exactly the same turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm.common import table

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)</s>|(?P<assistant>.*?)</s>",
    re.DOTALL,
)

ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
# Declarative layouts: field paths -> how turns are read. A step is (role, field) for one turn, or (list field, role field, text
# field) for one turn per entry. "roles" gives the canonical names of a layout that has names of its own; others keep theirs.
LAYOUTS: dict[str, dict] = {
    "messages": {"paths": ["messages", "messages[]", "messages[].role", "messages[].content"], "turns": [("messages", "role", "content")]},
    "share": {"paths": ["conversations", "conversations[]", "conversations[].from", "conversations[].value"], "turns": [("conversations", "from", "value")], "roles": ROLE_NAMES},
    "prompt_completion": {"paths": ["prompt", "completion"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    "prompt_response": {"paths": ["prompt", "response"], "turns": [("user", "prompt"), ("assistant", "response")]},
    "instruction": {"paths": ["instruction", "output"], "turns": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"paths": ["instruction", "input", "output"], "turns": [("user", ("instruction", "input")), ("assistant", "output")]},
    "system_instruction": {"paths": ["system", "instruction", "output"], "turns": [("system", "system"), ("user", "instruction"), ("assistant", "output")]},
    "question_answer": {"paths": ["question", "answer"], "turns": [("user", "question"), ("assistant", "answer")]},
    "empty_messages": {"paths": ["messages"], "turns": [("messages", "role", "content")]},
}


def field_paths(value, prefix: str = "") -> set[str]:
    """All nested field paths of a JSON value; an entry of a list adds ``[]``."""
    found: set[str] = set()
    todo = [(value, prefix)]
    while todo:
        v, at = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                path = f"{at}.{k}" if at else k
                found.add(path)
                todo.append((x, path))
        elif isinstance(v, list):
            for x in v:
                found.add(f"{at}[]")
                todo.append((x, f"{at}[]"))
    return found


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8")).hexdigest()[:16]


def mapping_table(layouts: dict[str, dict] = LAYOUTS) -> dict[str, tuple[str, list, dict[str, str]]]:
    """Fingerprint -> (layout name, turn steps, role names)."""
    return {fingerprint(x["paths"]): (name, x["turns"], x.get("roles", {})) for name, x in layouts.items()}


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def canonical_turns(record: dict, steps: list, roles: dict[str, str]) -> list[tuple[str, str]]:
    turns = []
    for step in steps:
        if len(step) == 3:
            turns += [(_text(x.get(step[1])), _text(x.get(step[2]))) for x in record[step[0]] or []]
        elif isinstance(step[1], tuple):
            turns.append((step[0], "\n".join(t for t in (_text(record.get(f)) for f in step[1]) if t)))
        else:
            turns.append((step[0], _text(record.get(step[1]))))
    return [(roles.get(role, role), text) for role, text in turns]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text, and the spans (code points, end exclusive) of the assistant texts in it: the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "user":
            piece = f"[INST] {body} [/INST]"
        elif role == "assistant":
            piece = f"{body}</s>"
            spans.append((at, at + len(body)))
        elif role == "system":
            piece = f"<<SYS>>{body}<</SYS>>"
        else:
            piece = f"[ROLE]{escape(role)}[/ROLE]{body}</s>"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for m in _TURN.finditer(formatted):
        kind = m.lastgroup
        if kind == "other":
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append((kind, unescape(m[kind])))
    return turns


def format_records(df: DataFrame, key: str = "conv_id", raw: str = "raw", layouts: dict[str, dict] = LAYOUTS) -> DataFrame:
    """``key``, ``raw`` (JSON text) -> key, fingerprint, layout, formatted, loss_spans.

    A record whose fingerprint is not in the table, or that is no JSON object, keeps its row: layout and formatted are
    null and the fingerprint of all its paths (null if it is no JSON) tells which mapping is missing. Null fields are empty texts; other
    values are kept as JSON. Repeated records are formatted each. Other columns are ignored."""
    mapping = mapping_table(layouts)
    known = {path for x in layouts.values() for path in x["paths"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw_text in batch["raw"]:
                mark = name = formatted = None
                spans: list[tuple[int, int]] = []
                try:
                    record = json.loads(raw_text) if raw_text is not None else None
                except ValueError:
                    record = None
                if isinstance(record, dict):
                    paths = field_paths(record)
                    mark = fingerprint(paths & known)
                    if mark in mapping:
                        name, steps, roles = mapping[mark]
                        formatted, spans = format_turns(canonical_turns(record, steps, roles))
                    else:
                        mark = fingerprint(paths)
                rows.append((mark, name, formatted, [{"start": a, "end": b} for a, b in spans]))
            got = pd.DataFrame(rows, columns=["fingerprint", "layout", "formatted", "loss_spans"])
            got.insert(0, "key", batch["key"].to_numpy())
            yield got

    schema = "key bigint, fingerprint string, layout string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(raw).alias("raw"))
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def turns_digest(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted texts say when read back: turns, their digest, and the text under the loss mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for formatted, spans in zip(batch["formatted"], batch["loss_spans"], strict=True):
                text = formatted or ""
                turns = read_back(text)
                said = "".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(said).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), len(text)))
            got = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            got.insert(0, "key", batch["key"].to_numpy())
            got["fingerprint"], got["layout"] = batch["fingerprint"].to_numpy(), batch["layout"].to_numpy()
            yield got

    schema = (
        "key bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
        "fingerprint string, layout string"
    )
    return df.withColumnRenamed(key, "key").mapInPandas(run, schema).withColumnRenamed("key", key)


def as_records(conversations: DataFrame) -> DataFrame:
    """One JSON record per conversation from its turn rows, in the layout that its roles allow: a single exchange as
    prompt / response, one with a system text as system / instruction / output, all else as a message list.

    Turns are ordered by turn, role, text (repeated rows stay); null texts and roles are empty. Each row without a
    conv_id is a conversation of its own. A conversation is one output text, so its turns meet in one row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), alone.alias("alone"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("content")).alias("m"),
    )
    grouped = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    roles = F.transform("ms", lambda m: m["role"])

    def is_(*names: str):
        return roles == F.array(*map(F.lit, names))

    def content(i: int):
        return F.get(F.col("ms"), i)["content"]

    messages = F.transform("ms", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    raw = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(content(0).alias("prompt"), content(1).alias("response"))))
        .when(
            is_("system", "user", "assistant"),
            F.to_json(F.struct(content(0).alias("system"), content(1).alias("instruction"), content(2).alias("output"))),
        )
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", raw.alias("raw"))


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    # The contract's extra conversation (fixed values).
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    return turns_digest(format_records(as_records(conversations.unionByName(extra))))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', NULL), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', NULL)
), e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\])', '\1\\\2', 'g') AS body FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15 ELSE 17 + length(role) END) AS formatted_chars,
         list(role ORDER BY turn, role, text) AS roles
  FROM e GROUP BY conv_id, alone
), l AS (
  SELECT *, CASE WHEN roles = ['user', 'assistant'] THEN 'prompt_response'
                 WHEN roles = ['system', 'user', 'assistant'] THEN 'system_instruction' ELSE 'messages' END AS layout FROM c)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, layout,
       left(sha256(CASE layout WHEN 'prompt_response' THEN 'prompt' || chr(10) || 'response'
            WHEN 'system_instruction' THEN 'instruction' || chr(10) || 'output' || chr(10) || 'system'
            ELSE 'messages' || chr(10) || 'messages[]' || chr(10) || 'messages[].content' || chr(10) || 'messages[].role' END), 16) AS fingerprint
FROM l"""
