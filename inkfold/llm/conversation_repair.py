"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, role state); its edges keep, rerole or delete the next row, or insert an empty turn. A
forward heap starts at the first row, a reverse heap behind the last; they stop when no crossing of equal cost can be open any more.
Of all cheapest paths, which then run through nodes settled from one side or the other, the least audit follows by taking the least
letter at each node.

A conversation of up to ``BLOCK`` turns is one search. A longer one is cut into blocks: the costs between the role states at both ends of
each block (4 x 4) are combined along the conversation, which gives the cost of the rest at each cut; then each block is searched on its
own, from every state it may be entered in, and the states met are chained. Texts stay out of all this: positions, faults and edits
are narrow tables, and texts are only streamed, in order, into the repaired conversation and its digest."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.llm.common import crc32_sql, rows_before, table
from inkfold.session import checkpointed

BLOCK = 4096
# Rows of one range of positions, at most about.
RANGE_ROWS = 250_000
# Costs of the edits (fixed values): Keep, Rerole, Delete, Insert, and what a truncated turn adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Role states: nothing yet, after system, after user, after assistant. The next turn to insert or rerole to from each of them.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
ENDS = (0, FAR, FAR, 0)


def _steps(turns: str, i: int, state: int, closing: bool) -> list[tuple[str, int, int, int]]:
    """Edges (letter, cost, rows consumed, state) out of a node, by letter. ``turns`` has two characters per row: the role's initial and
    the fault (``d`` to delete, ``t`` truncated, ``-`` none). ``closing``: turns may be inserted behind the last row."""
    out, n = [], len(turns) // 2
    if i < n:
        out.append(("D", DELETE, i + 1, state))
    if i < n or closing:
        out.append(("I", INSERT, i, NEXT[state]))
    if i < n and turns[2 * i + 1] != "d":
        more = TRUNCATED if turns[2 * i + 1] == "t" else 0
        kept = KEEP.get((state, turns[2 * i]))
        if kept is not None:
            out.append(("K", more, i + 1, kept))
        out.append(("R", REROLE + more, i + 1, NEXT[state]))
    return out


def _steps_back(turns: str, i: int, state: int, closing: bool) -> list[tuple[int, int, int]]:
    """Edges into a node, as (cost, rows consumed, state) of where they come from."""
    out, n = [], len(turns) // 2
    before = [p for p in range(4) if NEXT[p] == state]
    if i < n or closing:
        out += [(INSERT, i, p) for p in before]
    if i > 0:
        out.append((DELETE, i - 1, state))
        if turns[2 * i - 1] != "d":
            more = TRUNCATED if turns[2 * i - 1] == "t" else 0
            out += [(REROLE + more, i - 1, p) for p in before]
            out += [(more, i - 1, p) for p in range(4) if KEEP.get((p, turns[2 * i - 2])) == state]
    return out


def repair(turns: str, entry: int = START, ends: tuple[int, ...] = ENDS, closing: bool = True) -> tuple[int, str, int]:
    """Cost, least audit and last state of the cheapest repair from state ``entry``; ``ends`` is the cost still to come for each
    state behind the last row."""
    n = len(turns) // 2
    ahead, behind = {(0, entry): 0}, {(n, q): c for q, c in enumerate(ends) if c < FAR}
    forward, reverse = [(0, 0, entry)], [(c, -n, q) for (_, q), c in behind.items()]
    heapq.heapify(reverse)
    done_ahead, done_behind = set(), set()
    best = FAR
    # Nodes of equal cost leave a heap in the order of the free edges between them.
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        if forward[0][0] <= reverse[0][0]:
            cost, i, q = heapq.heappop(forward)
            if (i, q) in done_ahead:
                continue
            done_ahead.add((i, q))
            best = min(best, cost + behind.get((i, q), FAR))
            for _, c, j, p in _steps(turns, i, q, closing):
                if cost + c < ahead.get((j, p), FAR):
                    ahead[j, p] = cost + c
                    heapq.heappush(forward, (cost + c, j, p))
                    best = min(best, cost + c + behind.get((j, p), FAR))
        else:
            cost, i, q = heapq.heappop(reverse)
            i = -i
            if (i, q) in done_behind:
                continue
            done_behind.add((i, q))
            best = min(best, cost + ahead.get((i, q), FAR))
            for c, j, p in _steps_back(turns, i, q, closing):
                if cost + c < behind.get((j, p), FAR):
                    behind[j, p] = cost + c
                    heapq.heappush(reverse, (cost + c, -j, p))
                    best = min(best, cost + c + ahead.get((j, p), FAR))

    def crosses(node: tuple[int, int]) -> bool:
        """Whether a cheapest path leaves the forward side here."""
        here = ahead[node]
        if node[0] == n and here + ends[node[1]] == best:
            return True
        if node in done_behind and here + behind[node] == best:
            return True
        return any((j, p) in done_behind and here + c + behind[j, p] == best for _, c, j, p in _steps(turns, *node, closing))

    useful = {node for node in done_ahead if crosses(node)}
    stack = list(useful)
    while stack:
        i, q = stack.pop()
        for c, j, p in _steps_back(turns, i, q, closing):
            if (j, p) in done_ahead and (j, p) not in useful and ahead[j, p] + c == ahead[i, q]:
                useful.add((j, p))
                stack.append((j, p))

    audit, i, q, spent = [], 0, entry, 0
    while not (i == n and spent + ends[q] == best):
        for letter, c, j, p in _steps(turns, i, q, closing):
            if ((j, p) in done_behind and spent + c + behind[j, p] == best) or ((j, p) in useful and spent + c == ahead[j, p]):
                audit.append(letter)
                i, q, spent = j, p, spent + c
                break
        else:
            raise AssertionError("a cheapest path was lost")
    return spent, "".join(audit), q


@lru_cache(maxsize=4096)
def _repair_short(turns: str) -> tuple[int, str, int]:
    """Conversations of a few turns look much alike."""
    return repair(turns)


def crossing_costs(turns: str) -> list[int]:
    """Costs from each state before a block to each state behind it (row by row, 16 numbers), without insertions behind the last row."""
    n = len(turns) // 2
    table_ = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for i in reversed(range(n)):
        now = []
        for p in range(4):
            rows = [(c, q) for _, c, j, q in _steps(turns, i, p, False) if j > i]
            now.append([min((c + table_[q][e] for c, q in rows), default=FAR) for e in range(4)])
        for _ in range(3):
            now = [[min(now[p][e], INSERT + now[NEXT[p]][e]) for e in range(4)] for p in range(4)]
        table_ = now
    return [min(c, FAR) for row in table_ for c in row]


def edits_of(turns: str, audit: str, entry: int = START) -> list[tuple[str, str, str, str]]:
    """Per row: roles inserted before it (``u``, ``a``), its letter, the role it gets if that changes, roles inserted after the last row."""
    out, before, state, i = [], "", entry, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            before += ROLE[state][0]
            continue
        put = ""
        if letter == "K":
            state = KEEP[state, turns[2 * i]]
        elif letter == "R":
            state = NEXT[state]
            put = ROLE[state]
        out.append((before, letter, put, ""))
        before, i = "", i + 1
    if before:
        last = out[-1]
        out[-1] = (*last[:3], before)
    return out


def _order() -> list:
    return ["gone", F.col("turn").isNotNull(), "turn", "role", "mark", "row"]


def _spread(df: DataFrame, gone: Column | None) -> DataFrame:
    """The rows of ``df`` in ranges of their order, pinned, with all that the faults need to know of a text."""
    spark = df.sparkSession
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = df.select(
        F.coalesce(F.col("conv_id").cast("bigint").cast("string"), F.lit("-")).alias("conv"),
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        gone.alias("gone"),
    )
    rows = rows.withColumns(
        {
            "mark": F.md5("text"),
            "shown": F.col("text").rlike(r"[^\x20\x09-\x0D]"),
            "ended": F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
            "row": F.monotonically_increasing_id(),
        }
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    spread = rows.repartitionByRange(parts, "conv", *_order())
    return checkpointed(spread.withColumn("part", F.spark_partition_id().cast("bigint")))


def _placed(spread: DataFrame) -> DataFrame:
    """Place and fault of each row; texts stay behind."""
    spread = spread.drop("text")
    counts = spread.where("NOT gone").groupBy("conv", "part").agg(F.count("*").alias("n"))
    first = rows_before(counts, ["conv"], "part").drop("n").join(counts.groupBy("conv").agg(F.sum("n").alias("n")), "conv")
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*_order()))
    placed = spread.withColumn("pos", (inside - 1).cast("bigint")).join(first, ["conv", "part"], "left")
    placed = placed.withColumn("pos", F.col("pos") + F.col("before")).withColumn("block", F.floor(F.col("pos") / BLOCK))

    # The first place of each role and text, summed up per block, so that one turn repeated without end is no hot key.
    same = ["conv", "role", "mark"]
    firsts = placed.where("NOT gone").groupBy(*same, "block").agg(F.min("pos").alias("first"))
    firsts = firsts.withColumn("first", F.min("first").over(Window.partitionBy(*same).orderBy("block")))
    placed = placed.join(firsts, [*same, "block"], "left")
    fault = (
        F.when(~F.col("shown"), F.lit("blank"))
        .when(F.col("pos") > F.col("first"), F.lit("duplicate"))
        .when(~F.col("ended"), F.lit("truncated"))
        .otherwise(F.lit("none"))
    )
    columns = ["conv", "conv_id", "turn", "role", "gone", "pos", "n", "block", "row"]
    return checkpointed(placed.select(*columns, F.substring("role", 1, 1).alias("initial"), fault.alias("fault")))


def find_faults(df: DataFrame, gone: Column | None = None) -> DataFrame:
    """The rows of ``df`` (conv_id, turn, role, text) in their order: conv, conv_id, turn, role, gone, pos (from 0), n (turns of the
    conversation), initial, fault (blank, duplicate, truncated, none).

    Ordered by turn (null first), then role and digest of the text. Rows where ``gone`` holds are no turns; they only keep their
    conversation in the reports. Null roles and texts are one space. Rows without a conv_id are one conversation."""
    return _placed(_spread(df, gone))


def _edited(df: DataFrame, gone: Column | None) -> DataFrame:
    """The rows of ``find_faults`` with their edits and texts. Texts are moved once, by conversation and row."""
    spread = _spread(df, gone)
    rows = _placed(spread)
    told = rows.join(plan_repairs(rows), ["conv", "pos"], "left")
    return told.join(spread.select("conv", "row", "text"), ["conv", "row"])


EDITS = "conv string, pos bigint, before string, letter string, put string, after string"


def plan_repairs(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of ``find_faults``, one row per turn: conv, pos, before, letter, put, after (see ``edits_of``)."""
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("d")).when(F.col("fault") == "truncated", F.lit("t")).otherwise(F.lit("-"))
    members = F.array_sort(F.collect_list(F.struct("pos", F.concat(initial, code).alias("code"))))
    blocks = rows.where("NOT gone").groupBy("conv", "n", "block").agg(members.alias("ms"))
    blocks = checkpointed(blocks.select("conv", "n", "block", F.array_join("ms.code", "").alias("turns")))

    def rows_of(conv: str, block: int, edits: list[tuple[str, str, str, str]]) -> list[tuple]:
        return [(conv, block * BLOCK + i, *edit) for i, edit in enumerate(edits)]

    names = ["conv", "pos", "before", "letter", "put", "after"]

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, turns in zip(batch["conv"], batch["turns"], strict=True):
                audit = (_repair_short if len(turns) <= 64 else repair)(turns)[1]
                out += rows_of(conv, 0, edits_of(turns, audit))
            yield pd.DataFrame(out, columns=names)

    short = blocks.where(F.col("n") <= BLOCK).mapInPandas(alone, EDITS)
    long = blocks.where(F.col("n") > BLOCK)
    return short if long.isEmpty() else short.unionByName(_chained(long, rows_of, names))


def _chained(blocks: DataFrame, rows_of, names: list[str]) -> DataFrame:
    """Edits of conversations of several blocks. Only a few numbers per block meet in one task."""

    def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["conv", "block"]].assign(costs=[crossing_costs(t) for t in batch["turns"]])

    def rest(group: pd.DataFrame) -> pd.DataFrame:
        """The cost of the rest behind each block, for each state there. The last block closes the conversation itself."""
        group = group.sort_values("block")
        ends, now = [], list(ENDS)
        for i, c in enumerate(reversed(group["costs"].tolist())):
            ends.append(now)
            if i == 0:
                for _ in range(3):
                    now = [min(now[q], INSERT + now[NEXT[q]]) for q in range(4)]
            now = [min(int(c[4 * p + e]) + now[e] for e in range(4)) for p in range(4)]
        return group[["conv", "block"]].assign(ends=ends[::-1])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            audits, exits = [], []
            for turns, ends, n, block in zip(batch["turns"], batch["ends"], batch["n"], batch["block"], strict=True):
                found = [repair(turns, entry, tuple(int(e) for e in ends), closing=(block + 1) * BLOCK >= n) for entry in range(4)]
                audits.append([f[1] for f in found])
                exits.append([f[2] for f in found])
            yield batch[["conv", "block", "turns"]].assign(audits=audits, exits=exits)

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        entries, state = [], START
        for exits in group["exits"]:
            entries.append(state)
            state = int(exits[state])
        return group[["conv", "block"]].assign(entry=entries)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame(rows_of(r.conv, r.block, edits_of(r.turns, r.audits[r.entry], r.entry)), columns=names)

    priced = blocks.mapInPandas(costs, "conv string, block bigint, costs array<bigint>")
    ends = priced.groupBy("conv").applyInPandas(rest, "conv string, block bigint, ends array<bigint>")
    kinds = "conv string, block bigint, turns string, audits array<string>, exits array<bigint>"
    searched = checkpointed(blocks.join(ends, ["conv", "block"]).mapInPandas(search, kinds))
    entries = searched.select("conv", "block", "exits").groupBy("conv").applyInPandas(chain, "conv string, block bigint, entry bigint")
    return searched.join(entries, ["conv", "block"]).mapInPandas(tell, EDITS)


def repaired_turns(df: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, pos and part (the order), role, text, edit (K, R or I). A reroled turn keeps its text, an
    inserted one has none."""
    told = _edited(df, gone).where("NOT gone")
    names = F.create_map(*[F.lit(x) for pair in (("u", "user"), ("a", "assistant")) for x in pair])

    def inserted(letters: str) -> Column:
        each = F.filter(F.split(F.col(letters), ""), lambda x: x != "")
        return F.transform(each, lambda x: F.struct(F.element_at(names, x).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))

    own = F.struct(F.when(F.col("letter") == "R", F.col("put")).otherwise(F.col("role")).alias("role"), "text", F.col("letter").alias("edit"))
    kept = F.filter(F.array(own), lambda x: x["edit"] != "D")
    turns = told.select("conv_id", "pos", F.posexplode(F.concat(inserted("before"), kept, inserted("after"))).alias("part", "turn"))
    return turns.select("conv_id", "pos", "part", "turn.role", "turn.text", "turn.edit")


def repair_report(df: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation all of whose rows are ``gone`` has zeros, an empty audit and the digest of the empty string. Null roles and texts are one
    space, so such a text is blank; null turns come first and count in no gap; rows without a conv_id are one conversation with a null id.
    Repeated rows are turns of their own. An empty table gives an empty result. Other columns are ignored. The digest of a
    conversation has to be taken in its order, so its texts pass through one task, one by one."""
    told = _edited(df, gone)
    columns = ["conv", "conv_id", "gone", "turn", "role", "text", "initial", "fault", "before", "letter", "put", "after", "pos"]
    ordered = told.select(*columns).repartition("conv").sortWithinPartitions("conv", "gone", "pos")
    kinds = (
        "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
        "repaired_sha256 string"
    )
    names = [k.split()[0] for k in kinds.split(", ")]
    inserted = {"u": "user:", "a": "assistant:"}

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None

        def close() -> tuple:
            gaps = 0 if low is None else high - low + 1 - distinct
            return (conv_id, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(audit), sha.hexdigest())

        for batch in batches:
            out = []
            turns = batch["turn"].astype("object").where(batch["turn"].notna(), None)
            ids = batch["conv_id"].astype("object").where(batch["conv_id"].notna(), None)
            for r, turn, conv in zip(batch.itertuples(index=False), turns, ids, strict=True):
                if r.conv != now:
                    if now is not None:
                        out.append(close())
                    now, conv_id = r.conv, None if conv is None else int(conv)
                    low = high = last = None
                    distinct, illegal, cost, lines = 0, 0, 0, 0
                    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
                    audit, sha = [], hashlib.sha256()
                if r.gone:
                    continue
                if turn is not None:
                    turn = int(turn)
                    distinct += turn != high
                    low, high = turn if low is None else low, turn
                counts[r.fault] += 1
                illegal += last is not None and last + r.initial not in ("su", "ua", "au")
                last = r.initial
                pieces = [inserted[c] for c in r.before]
                if r.letter != "D":
                    pieces.append(f"{r.put or r.role}:{r.text}")
                pieces += [inserted[c] for c in r.after]
                more = TRUNCATED if r.fault == "truncated" and r.letter != "D" else 0
                cost += INSERT * (len(r.before) + len(r.after)) + {"K": 0, "R": REROLE, "D": DELETE}[r.letter] + more
                audit.append("I" * len(r.before) + r.letter + "I" * len(r.after))
                for piece in pieces:
                    sha.update((("\n" if lines else "") + piece).encode("utf-8"))
                    lines += 1
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([close()], columns=names)

    return ordered.mapInPandas(stream, kinds)


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The contract's damage by the checksum of ``conv_id:turn`` modulo 20, and the condition of rows that are dropped."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")), F.col("kind") == 0


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_report(*damage(table(spark, folder, "conversations")))


OP13_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM raw, range(2) AS q(copy)
  WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, left(role, 1) AS ini,
         count(*) OVER (PARTITION BY conv_id) AS n FROM damaged
), seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM placed),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM seen
), ins(q, s, c, q2, lines) AS (VALUES
  (0, '', 0, 0, []::VARCHAR[]), (0, 'I', 3, 2, ['user:']), (0, 'II', 6, 3, ['user:', 'assistant:']),
  (1, '', 0, 1, []), (1, 'I', 3, 2, ['user:']), (1, 'II', 6, 3, ['user:', 'assistant:']),
  (2, '', 0, 2, []), (2, 'I', 3, 3, ['assistant:']), (2, 'II', 6, 2, ['assistant:', 'user:']),
  (3, '', 0, 3, []), (3, 'I', 3, 2, ['user:']), (3, 'II', 6, 3, ['user:', 'assistant:'])
), op(q2, letter, ini, q3, c) AS (VALUES
  (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4), (0, 'R', '', 2, 3), (1, 'R', '', 2, 3), (2, 'R', '', 3, 3), (3, 'R', '', 2, 3),
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)
), best(conv_id, i, q, b) AS (
  SELECT DISTINCT conv_id, n + 1, q, {{'cost': e.c, 'audit': e.s, 'lines': e.lines}} FROM f,
    (SELECT q, c, s, lines FROM ins WHERE (q = 0 AND s = '') OR (q = 1 AND s = 'II') OR (q = 2 AND s = 'I') OR (q = 3 AND s = '')) AS e
  UNION ALL
  SELECT conv_id, i, q, min(b) FROM (
    SELECT f.conv_id, f.i, ins.q, {{
      'cost': ins.c + op.c + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END + best.b.cost, 'audit': s || letter || best.b.audit,
      'lines': lines || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
               ELSE [CASE q3 WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text] END || best.b.lines}} AS b
    FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i - 1 JOIN op ON op.q3 = best.q JOIN ins ON ins.q2 = op.q2
    WHERE (op.ini = '' OR op.ini = f.ini) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
  ) GROUP BY conv_id, i, q
), facts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM raw) AS r LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM r.conv_id
LEFT JOIN (SELECT * FROM best WHERE i = 1 AND q = 0) AS z ON z.conv_id IS NOT DISTINCT FROM r.conv_id"""
