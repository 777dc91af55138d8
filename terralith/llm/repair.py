"""Repair of conversations: the cheapest edits that make turns alternate, by a cost DP and prefix-doubling path ranks.

A conversation's rows become one code each; the DP gives the least cost from every (row, state) to the end.
The arcs that keep to this cost form a graph whose paths spell the cheapest audits. Nodes are ranked by the
first 1, 2, 4 .. letters of their least audit, each rank from two of the level before; the ranks choose one arc
a node, and doubled pointers walk from all starts at once.

Defined results: a null role, text, turn or conv_id counts as one space where the damage rule or a line reads
it; null conv_ids are one conversation; rows of one turn follow by role, then text; repeated rows are duplicates
of the first; columns beside conv_id, turn, role and text are ignored; an empty table gives an empty result;
turns too far apart for a long give the greatest long as gaps. Texts stay in sorted streams, so a text or a
conversation of any length passes; one byte a row, and the DP's 200 or so, is what a conversation holds in memory.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.llm.common import materialize, small_batches, streamed_sha256, table

WORD = r"[^\x20\x09-\x0D]"
#: Fixed costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Edits as letters, in the order that breaks ties, and states: nothing yet, after system, after user, after assistant.
LETTERS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that each kind of row (initial s, u, a or another) leads to from each state; -1: not allowed.
KEEPS = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
TURN = np.array([USER, USER, ASSISTANT, USER])
FAR = 1 << 40


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of the rows that the damage rule leaves."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def examined(rows: DataFrame) -> DataFrame:
    """rows with pos, fault (none, blank, duplicate, truncated), initial, illegal and fresh (a turn's first row)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long") - 1).withColumn("initial", F.left("role", F.lit(1)))
    before, last = F.lag("initial").over(order), F.lag("turn").over(order)
    rows = rows.withColumn("illegal", F.coalesce(~F.concat(before, "initial").isin("su", "ua", "au"), F.lit(False)))
    rows = rows.withColumn("fresh", F.col("turn").isNotNull() & (last.isNull() | (last != F.col("turn"))))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos"))
    end = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(seen > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("none")
    return rows.withColumn("fault", fault)


def summaries(rows: DataFrame) -> DataFrame:
    """Per conversation the counts of its faults, and codes: a letter a row for its initial and fault."""
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    pen = F.when(F.col("fault") == "none", 0).when(F.col("fault") == "truncated", 1).otherwise(2)
    coded = F.struct("pos", F.char(65 + kind * 3 + pen).alias("code"))
    wide = F.coalesce(F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count_if("fresh"), F.lit(0))
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    codes = F.concat_ws("", F.transform(F.array_sort(F.collect_list(coded)), lambda s: s["code"]))
    return rows.groupBy("conv_id").agg(F.least(wide, F.lit(2**63 - 1)).cast("long").alias("gaps"), *counts, F.count_if("illegal").alias("illegal"), codes.alias("codes"))


# ------------------------------------------------------------------ the DP and the ranks


def _costs(kind: np.ndarray, pen: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Least cost from each (place, state) to the end; a conversation has the places first .. first + size."""
    v = np.full((int(sizes.sum()) + len(sizes), 4), FAR, np.int64)
    longest = np.argsort(-sizes, kind="stable")
    active = len(sizes)
    for left in range(int(sizes.max(initial=0)) + 1):
        while active and sizes[longest[active - 1]] < left:
            active -= 1
        at = (first + sizes - left)[longest[:active]]
        if left == 0:
            base = np.tile(np.array([0, FAR, FAR, 0]), (active, 1))
        else:
            after = v[at + 1]
            stay = np.where(pen[at] == 2, FAR, TRUNCATED * (pen[at] == 1))[:, None]
            to = KEEPS[kind[at]]
            keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), FAR) + stay
            base = np.minimum(np.minimum(DELETE + after, keep), REROLE + after[:, TURN] + stay)
        pair = np.minimum(base[:, [USER, ASSISTANT]], INSERT + base[:, [ASSISTANT, USER]])
        base = np.minimum(base, INSERT + pair[:, [0, 0, 1, 0]])
        v[at] = np.minimum(base, FAR)
    return v


def _arcs(v: np.ndarray, kind: np.ndarray, pen: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each node (place * 4 + state) the node that each letter leads to at least cost, or -1."""
    places, states = np.repeat(np.arange(len(v)), 4), np.tile(np.arange(4), len(v))
    stay = np.where(pen == 2, FAR, TRUNCATED * (pen == 1))[places]
    kept = KEEPS[kind[places], states]
    ways = [(DELETE, 1, states), (INSERT, 0, TURN[states]), (stay, 1, kept), (REROLE + stay, 1, TURN[states])]
    out = np.full((len(places), 4), -1, np.int64)
    flat = v.reshape(-1)
    for k, (cost, step, to) in enumerate(ways):
        possible = (to >= 0) & ~(last[places] & (step == 1))
        node = np.where(possible, np.minimum(places + step, len(v) - 1) * 4 + np.maximum(to, 0), 0)
        out[:, k] = np.where(possible & (cost + flat[node] == flat), node, -1)
    return out


def _ranks(arcs: np.ndarray) -> np.ndarray:
    """Rank of each node's least audit, from the ranks of its first 1, 2, 4 .. letters; 0 at the end."""
    ends = (arcs < 0).all(axis=1)
    label = np.argmax(arcs >= 0, axis=1)
    jump = np.where(ends, np.arange(len(arcs)), np.take_along_axis(arcs, label[:, None], 1)[:, 0])
    rank = np.where(ends, 0, label + 1)
    while not ends[jump].all():
        both = rank * (int(rank.max()) + 1) + rank[jump]
        rank, jump = np.unique(both, return_inverse=True)[1], jump[jump]
    both = rank * (int(rank.max()) + 1) + rank[jump]
    return np.unique(both, return_inverse=True)[1]


def repair(codes: list[str]) -> tuple[list[int], list[str]]:
    """Cost and audit of each conversation, given as its rows' codes."""
    if not codes:
        return [], []
    sizes = np.array([len(c) for c in codes], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer("".join(c + "A" for c in codes).encode(), np.uint8).astype(np.int64) - 65
    kind, pen = raw // 3, raw % 3
    last = np.zeros(len(raw), bool)
    last[first + sizes] = True
    v = _costs(kind, pen, first, sizes)
    arcs = _arcs(v, kind, pen, last)
    ranks = _ranks(arcs)
    # of a node's cheapest arcs the one whose letter, then whose target's audit, is least
    key = np.where(arcs >= 0, np.arange(4) * (int(ranks.max()) + 1) + ranks[np.maximum(arcs, 0)], FAR)
    chosen = np.argmin(key, axis=1)
    ends = (arcs < 0).all(axis=1)
    jump = np.where(ends, np.arange(len(arcs)), np.take_along_axis(arcs, chosen[:, None], 1)[:, 0])
    node, conv, step, far = first * 4, np.arange(len(codes)), np.zeros(len(codes), np.int64), 1
    node, conv, step = (x[~ends[first * 4]] for x in (node, conv, step))
    while True:
        on = ~ends[jump[node]]
        if not on.any():
            break
        node, conv, step = np.append(node, jump[node[on]]), np.append(conv, conv[on]), np.append(step, step[on] + far)
        jump, far = jump[jump], 2 * far
    order = np.lexsort((step, conv))
    letters = np.frombuffer(LETTERS.encode(), np.uint8)[chosen[node[order]]].tobytes().decode()
    cut = np.searchsorted(conv[order], np.arange(len(codes) + 1))
    return v[first, START].tolist(), [letters[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def plan(audit: str, codes: str) -> list[tuple[str | None, str]]:
    """Per row the lines to insert before it (None: none) and what becomes of it: K, D, user or assistant;
    the last entry holds what follows the last row."""
    out, lead, state = [], [], START
    for a in audit:
        turn = int(TURN[state])
        name = "user" if turn == USER else "assistant"
        if a == "I":
            lead.append(f"{name}:")
        else:
            out.append(("\n".join(lead) if lead else None, name if a == "R" else a))
            lead = []
        if a != "D":
            system = a == "K" and (ord(codes[len(out) - 1]) - 65) // 3 == 0
            state = SYSTEM if system else turn
    return [*out, ("\n".join(lead) if lead else None, "D")]


def _repair(batches):
    import pyarrow as pa

    step = pa.struct([("lead", pa.string()), ("act", pa.string())])
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        costs, audits = repair(codes)
        plans = [[{"lead": a, "act": b} for a, b in plan(x, c)] for x, c in zip(audits, codes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(plans, pa.list_(step))], ["conv_id", "cost", "audit", "plan"])


def repaired(conversations: DataFrame) -> DataFrame:
    """Per conversation its counts, cost and audit, and pieces: nothing of the texts but their digest."""
    spark = conversations.sparkSession
    small_batches(spark)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = examined(damaged(conversations))
    found = materialize(summaries(rows), "repair-codes")
    plans = found.select("conv_id", "codes").mapInArrow(_repair, f"conv_id {kind}, cost bigint, audit string, plan array<struct<lead:string,act:string>>")
    plans = materialize(plans, "repair-plans")
    steps = plans.select("conv_id", F.posexplode("plan").alias("at", "step")).select("conv_id", F.col("at").cast("long").alias("at"), "step.lead", "step.act").where("lead IS NOT NULL OR act <> 'D'")
    own = F.when(F.col("act") == "K", F.concat("role", F.lit(":"), "text")).when(F.col("act") != "D", F.concat("act", F.lit(":"), "text"))
    lines = steps.alias("s").join(rows.select("conv_id", "pos", "role", "text").hint("merge").alias("r"), F.expr("s.conv_id <=> r.conv_id AND s.at = r.pos"), "left")
    lines = lines.select("s.conv_id", "at", F.concat_ws("\n", "lead", own).alias("piece"))
    digests = streamed_sha256(lines, "conv_id", "at", "\n")
    every = conversations.select("conv_id").distinct()
    out = every.alias("e").join(found.drop("codes").alias("f"), F.expr("e.conv_id <=> f.conv_id"), "left").join(plans.drop("plan").alias("p"), F.expr("e.conv_id <=> p.conv_id"), "left").join(digests.alias("d"), F.expr("e.conv_id <=> d.conv_id"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    sha = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return out.select("e.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), sha)


def op11_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
#: CRC-32 of an ASCII text; t.crc is the table of its 256 remainders.
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8)))"
CRC_TABLE = f"(SELECT {_CRC_TABLE} AS crc)"

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AFTER = {START: "s0", SYSTEM: "s1", USER: "s2", ASSISTANT: "s3"}


def _sql_step(state: int) -> str:
    """The least (cost, audit, text) of a state before a row, inserts not counted; b holds the states after it."""
    turn = _AFTER[int(TURN[state])]
    name = "user" if TURN[state] == USER else "assistant"
    put = lambda c, a, line, to: f"{{'c': {c} + b.{to}.c, 'a': '{a}' || b.{to}.a, 't': list_prepend({line}, b.{to}.t)}}"
    never = "{'c': 1000000, 'a': 'Z', 't': []::VARCHAR[]}"
    ways = [f"{{'c': 2 + b.{_AFTER[state]}.c, 'a': 'D' || b.{_AFTER[state]}.a, 't': b.{_AFTER[state]}.t}}"]
    for k, initial in enumerate("sua"):
        if KEEPS[k, state] >= 0:
            ways.append(f"CASE WHEN initial = '{initial}' AND pen < 2 THEN {put('5 * pen', 'K', 'line', _AFTER[int(KEEPS[k, state])])} ELSE {never} END")
    line = f"'{name}:' || text"
    ways.append(f"CASE WHEN pen < 2 THEN {put('1 + 5 * pen', 'R', line, turn)} ELSE {never} END")
    return f"list_min([{', '.join(ways)}])"


def _sql_insert(state: int) -> str:
    """A state's own best or that of the state that an inserted turn leads to."""
    to = _AFTER[int(TURN[state])]
    name = "user" if TURN[state] == USER else "assistant"
    return f"least({_AFTER[state]}, {{'c': 5 + {to}.c, 'a': 'I' || {to}.a, 't': list_prepend('{name}:', {to}.t)}})"


def oracle_sql() -> str:
    end = "{{'c': {}, 'a': '{}', 't': {}}}"
    at_end = [end.format(0, "", "[]::VARCHAR[]"), end.format(10, "II", "['user:', 'assistant:']"), end.format(5, "I", "['assistant:']"), end.format(0, "", "[]::VARCHAR[]")]
    mutual = f"SELECT conv_id, place, s0, s1, {_sql_insert(USER)} AS s2, {_sql_insert(ASSISTANT)} AS s3 FROM base"
    both = f"SELECT conv_id, place, {_sql_insert(START)} AS s0, {_sql_insert(SYSTEM)} AS s1, s2, s3 FROM mutual"
    base = f"SELECT x.conv_id, x.pos AS place, {', '.join(f'{_sql_step(k)} AS s{k}' for k in range(4))} FROM best b JOIN coded x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.pos = b.place - 1"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""WITH RECURSIVE t AS {CRC_TABLE},
fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format(key)} % 20 AS fate FROM conversations, t),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS pos, left(role, 1) AS initial FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
coded AS MATERIALIZED (SELECT *, role || ':' || text AS line, CASE WHEN rtrim(text, {_SPACES}) = '' OR nth > 1 THEN 2 WHEN right(rtrim(text, {_SPACES}), 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS pen,
  rtrim(text, {_SPACES}) = '' AS blank, before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
counts AS (SELECT conv_id, max(pos) + 1 AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (NOT blank AND nth > 1) AS duplicate, count(*) FILTER (pen = 1) AS truncated, count(*) FILTER (illegal) AS illegal FROM coded GROUP BY conv_id),
best AS (SELECT conv_id, n AS place, {', '.join(f'{e} AS s{k}' for k, e in enumerate(at_end))} FROM counts
  UNION ALL (WITH base AS ({base}), mutual AS ({mutual}) {both}))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.s0.c, 0) AS BIGINT) AS cost, coalesce(b.s0.a, '') AS audit, sha256(coalesce(array_to_string(b.s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id AND b.place = 0"""
