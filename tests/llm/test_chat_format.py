import json

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from check import connect, rows
from inkfold.llm.chat_format import CONTROLS, OP1_SQL, as_records, escape, format_records, format_turns, op1_chat_format, read_back, turns_digest, unescape

PIECE = st.one_of(st.sampled_from([*CONTROLS, "\\", " ", "[", "<", "/", "\n", "user"]), st.text(max_size=5))
TEXT = st.lists(PIECE, max_size=6).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_round_trip(turns):
    formatted, spans = format_turns(turns)
    assert read_back(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_no_control_string_survives_in_a_text(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"messages": []}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]},
        {"prompt": "p", "completion": "c"}, {"completion": "c", "prompt": 3}, {"instruction": "i", "input": "", "output": "o"},
        {"system": "s", "instruction": "i", "output": "o"}, {"question": "q", "answer": "a"}, {"other": {"x": [1]}},
    ]
    raws = [json.dumps(r) for r in records] + ["{broken", None, "[1]", '"x"']
    df = spark.createDataFrame([(i, r, "z") for i, r in enumerate(raws)], "conv_id bigint, raw string, layout string")
    out = {r.conv_id: r for r in format_records(df).collect()}
    assert len(out) == len(raws)
    assert read_back(out[0].formatted) == [("user", "a"), ("assistant", "b")] and out[1].formatted == ""
    assert read_back(out[2].formatted) == [("user", "a"), ("assistant", "")]
    assert out[3].fingerprint == out[4].fingerprint and read_back(out[4].formatted)[0] == ("user", "3")
    assert read_back(out[5].formatted) == [("user", "i"), ("assistant", "o")] and read_back(out[6].formatted)[0] == ("system", "s")
    assert out[8].layout is None and out[8].fingerprint and all(out[i].fingerprint is None for i in (9, 10, 11, 12))


def test_further_fields_do_not_hide_a_layout(spark):
    records = [
        {"id": 7, "name": None, "meta": {"tags": ["x"]}, "prompt": "p", "completion": "c"},
        {"id": 8, "messages": [{"role": "human", "content": "a", "name": "ann"}, {"role": "gpt", "content": "b"}]},
        {"prompt": "p", "completion": "c", "question": "q", "answer": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id bigint, raw string")
    out = {r.conv_id: r for r in format_records(df).collect()}
    assert out[0].layout == "prompt_completion" and read_back(out[0].formatted) == [("user", "p"), ("assistant", "c")]
    # A message list keeps its role names; two layouts in one record are none.
    assert read_back(out[1].formatted) == [("human", "a"), ("gpt", "b")] and out[2].layout is None


def test_foreign_roles_and_null_conversations_equal_sql(spark, tmp_path):
    data = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (None, 0, "user", "n"), (None, 1, "model", "m"), (3, None, None, None)]
    spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert rows(op1_chat_format(spark, str(tmp_path)).toPandas()) == rows(con.execute(OP1_SQL).df())


def test_nulls_ties_long_and_empty(spark):
    rows_ = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "user", "a"), (None, 1, "user", "b"), (2, 0, "assistant", "y" * 300000)]
    df = spark.createDataFrame(rows_, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'k' AS raw", "1 AS alone")
    got = sorted((r.conv_id is None, r.conv_id or 0, r.n_turns, r.loss_chars) for r in turns_digest(format_records(as_records(df))).collect())
    assert got == [(False, 1, 3, 0), (False, 2, 1, 300000), (True, 0, 1, 0), (True, 0, 1, 0)]
    assert turns_digest(format_records(as_records(df.limit(0)))).count() == 0


def test_query_equals_sql(spark, sf):
    got = op1_chat_format(spark, sf).toPandas()
    assert rows(got) == rows(connect(sf).execute(OP1_SQL).df())
    assert (got.conv_id == -7).sum() == 1
