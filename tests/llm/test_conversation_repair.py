import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from check import connect, rows
from inkfold.llm import conversation_repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, cost int"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def brute(turns):
    """Cheapest (cost, audit, role initials) over all edits, from the contract: at most two insertions in one place."""
    n = len(turns) // 2

    @lru_cache(maxsize=None)
    def best(i, said):
        """``said`` is what the grammar still tells about the turns so far: '', 's', 'u' (after user) or 'a'."""
        found = []

        def step(letter, cost, nxt, role):
            if role is None:
                after = said
            elif (said, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                after = role
            else:
                return
            rest = best(nxt, after) if nxt > i else inserted(nxt, after)
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1], (role or "") + rest[2]))

        def inserted(at, after):
            return best_without(at, after)

        for r in "ua":
            step("I", 3, i, r)
        direct(i, said, step, found)
        return min(found) if found else None

    def direct(i, said, step, found):
        if i == n:
            if said in ("", "a"):
                found.append((0, "", ""))
            return
        initial, fault = turns[2 * i], turns[2 * i + 1]
        step("D", 4, i + 1, None)
        if fault != "d":
            more = 3 if fault == "t" else 0
            step("K", more, i + 1, initial)
            for r in "ua":
                step("R", 3 + more, i + 1, r)

    @lru_cache(maxsize=None)
    def best_without(i, said):
        """After one insertion: one more at most."""
        found = []

        def step(letter, cost, nxt, role):
            after = said if role is None else role if (said, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None
            if after is None:
                return
            rest = best(nxt, after) if nxt > i else last(nxt, after)
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1], (role or "") + rest[2]))

        for r in "ua":
            step("I", 3, i, r)
        direct(i, said, step, found)
        return min(found) if found else None

    @lru_cache(maxsize=None)
    def last(i, said):
        found = []

        def step(letter, cost, nxt, role):
            after = said if role is None else role if (said, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None
            if after is not None:
                rest = best(nxt, after)
                if rest is not None:
                    found.append((cost + rest[0], letter + rest[1], (role or "") + rest[2]))

        direct(i, said, step, found)
        return min(found) if found else None

    return best(0, "")


def test_search_equals_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        turns = "".join(rng.choice("suax") + rng.choice("---td") for _ in range(rng.randint(1, 9)))
        cost, audit, roles = brute(turns)
        assert GOOD.match(roles)
        assert R.repair(turns)[:2] == (cost, audit), turns
        edits = R.edits_of(turns, audit)
        assert "".join("I" * len(b) + k + "I" * len(a) for b, k, _, a in edits) == audit
        made = "".join(b + ("" if k == "D" else put[:1] or turns[2 * i]) + a for i, (b, k, put, a) in enumerate(edits))
        assert made == roles


def test_block_costs_add_up():
    rng = random.Random(6)
    for _ in range(300):
        turns = "".join(rng.choice("suax") + rng.choice("---td") for _ in range(rng.randint(2, 12)))
        cut = 2 * rng.randint(1, len(turns) // 2 - 1)
        costs = R.crossing_costs(turns[:cut])
        ends = tuple(R.repair(turns[cut:], q)[0] for q in range(4))
        whole = R.repair(turns)
        assert min(costs[e] + ends[e] for e in range(4)) == whole[0]
        head = R.repair(turns[:cut], R.START, ends, closing=False)
        tail = R.repair(turns[cut:], head[2])
        assert head[1] + tail[1] == whole[1]


def expected(data):
    """The report of one conversation's rows (turn, role, text), from the contract."""
    data = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in data:
        visible = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "none" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    known = [t for t, _, _ in data if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(data, data[1:], strict=False)]
    illegal = sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in pairs)
    code = {"blank": "d", "duplicate": "d", "truncated": "t", "none": "-"}
    turns = "".join((r[1][:1] if r[1][:1] in set("sua") else "x") + code[f] for r, f in zip(data, faults, strict=True))
    cost, audit, _ = brute(turns) if data else (0, "", "")
    out, i, roles = [], 0, ""
    for letter in audit:
        nxt = "a" if roles.endswith("u") else "u"
        full = {"u": "user", "a": "assistant"}[nxt]
        if letter == "I":
            out.append(full + ":")
            roles += nxt
            continue
        if letter == "K":
            out.append(f"{data[i][1]}:{data[i][2]}")
            roles += data[i][1][:1]
        if letter == "R":
            out.append(f"{full}:{data[i][2]}")
            roles += nxt
        i += 1
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest), out


def made(seed, count, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(count):
        for i in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else i + rng.choice([0, 0, 0, 1])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "unknown"])
            text = rng.choice([f"Said {rng.randint(0, 3)}.", "no end", "", None, " \t\n", "ok?", "é!\n ", "x "])
            out.append((conv if conv else None, turn, role, text, "x", i))
    return out


def report(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_report_and_turns(spark):
    data = made(1, 60, 9)
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = report(R.repair_report(df))
    turns = {}
    for r in R.repaired_turns(df).orderBy("pos", "part").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv in {r[0] for r in data}:
        want, lines = expected([(r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in data if r[0] == conv])
        assert got[conv] == want and turns.get(conv, []) == lines
    assert len(got) == len({r[0] for r in data})


def test_long_conversations_in_blocks(spark, monkeypatch):
    data = made(2, 6, 70)
    df = spark.createDataFrame(data, SCHEMA)
    whole = report(R.repair_report(df))
    monkeypatch.setattr(R, "BLOCK", 4)
    monkeypatch.setattr(R, "RANGE_ROWS", 10)
    assert report(R.repair_report(df)) == whole


def test_one_turn_repeated_and_long_text(spark):
    many = [(1, 3, "user", "again.", "x", 0)] * 5000 + [(2, 0, "user", "a " * 200_000, "x", 0)]
    got = report(R.repair_report(spark.createDataFrame(many, SCHEMA)))
    assert got[1][:7] == (0, 0, 4999, 0, 4999, 4 * 4999 + 3, "K" + "D" * 4999 + "I")
    assert got[2][:7] == (0, 0, 0, 1, 0, 4, "D")


def test_empty_and_gone(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repair_report(empty).count() == 0 and R.repaired_turns(empty).count() == 0
    one = spark.createDataFrame([(4, 0, "user", "hello.", "x", 0)], SCHEMA)
    got = report(R.repair_report(one, one["conv_id"] == 4))
    assert got == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_damage(spark):
    data = [(c if c else None, t if t else None, "assistant", f"One. Two! {t}?", "x", 0) for c in range(30) for t in range(8)]
    rows_, dropped = R.damage(spark.createDataFrame(data, SCHEMA))
    got = sorted(map(str, rows_.where(~dropped).select("conv_id", "turn", "role", "text").collect()))
    want = []
    for c, t, role, text, _, _ in data:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    made_ = spark.createDataFrame(want, "conv_id bigint, turn bigint, role string, text string").collect()
    assert got == sorted(map(str, made_))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_sql(spark, folder):
    assert rows(R.op13_conversation_repair(spark, folder).toPandas()) == rows(connect(folder).execute(R.OP13_SQL).df())
