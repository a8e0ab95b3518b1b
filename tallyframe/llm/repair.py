"""Repair of conversation structure by dynamic programming over runs.

Every row of a conversation is a symbol: its role's initial (s, u, a or another) and its fault. Equal neighbours collapse
into a run. A symbol is a min-plus matrix over the four states of the wanted order ``(s?(ua)+)?`` (nothing yet, after s,
after u, after a); a run of length n is that matrix to the power n, put together from cached binary powers. The costs to go
are advanced run by run from the end; the audit is then unrolled from the start, each run halved down to single rows, taking
the ASCII-least edit among the cheapest.

Edits: Keep (0), Rerole to user or assistant (3), Delete (4, the only edit of blank and duplicate rows), Insert an empty
user or assistant row (3). A truncated row that stays adds 3.

Rows reach a task sorted by conversation and turn, spill to disk while they are sorted, and are streamed. Faults and plans
are made from narrow rows without texts; the texts are streamed once more past the finished plan, so a task holds the runs
and the audit of one conversation, never its texts.

Defined cases: null roles and texts are one space; a null turn comes first, a null conversation is one of its own. Rows
that share a turn are ordered by role and by the digest of their text; repeated rows are duplicates. Empty texts are blank,
very long ones are streamed. An empty role is like any other unknown role. An empty table gives no rows; extra columns are
ignored. A conversation without rows has zeros, an empty audit and an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyframe.llm.registry import query
from tallyframe.llm.shared import SPACE, SPACE_CHARS, table, written

# States: nothing yet, after s, after u, after a. ``NEXT`` is the state that a user or assistant row leads to.
START, SYSTEM, USER, BOT = range(4)
NEXT = (USER, USER, BOT, USER)
# What an Insert or a Rerole writes there, by the state that it leads to.
ROLE = {USER: "user", BOT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
#: Inserts that close a conversation, by state.
CLOSING = ("", "II", "I", "")
SOUND, GONE, SHORT = range(3)
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}


def kept_state(state: int, initial: str) -> int | None:
    """Where keeping a row of this initial leads, None where the order forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return BOT if initial == "a" and state == USER else None


def edits(symbol: tuple[str, int], state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) that use up one row, letters in ASCII order."""
    initial, fault = symbol
    out = [("D", DELETE, state)]
    if fault != GONE:
        extra = TRUNCATED if fault == SHORT else 0
        kept = kept_state(state, initial)
        if kept is not None:
            out.append(("K", KEEP + extra, kept))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[p][m] + b[m][q] for m in range(4)) for q in range(4)) for p in range(4))


def advance(a: Matrix, to_go: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(a[p][q] + to_go[q] for q in range(4)) for p in range(4))


@lru_cache(maxsize=None)
def power(symbol: tuple[str, int], k: int) -> Matrix:
    """Transition of ``2 ** k`` rows of one symbol, each with inserts before it; at most 12 symbols and 64 powers."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    one = [[FAR] * 4 for _ in range(4)]
    for start in range(4):
        state, paid = start, 0
        for _ in range(3):
            for _, cost, after in edits(symbol, state):
                one[start][after] = min(one[start][after], paid + cost)
            state, paid = NEXT[state], paid + INSERT
    return tuple(map(tuple, one))


def run_back(symbol: tuple[str, int], length: int, to_go: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a run, from those behind it."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            to_go = advance(power(symbol, k), to_go)
    return to_go


def one_row(symbol: tuple[str, int], state: int, to_go: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of one row, with the inserts before it, and the state behind it."""
    before, out = advance(power(symbol, 0), to_go), ""
    while True:
        letters = [(*e, to_go) for e in edits(symbol, state)] + [("I", INSERT, NEXT[state], before)]
        letter, state, used = next((x, after, x != "I") for x, cost, after, rest in sorted(letters, key=lambda e: e[0]) if cost + rest[after] == before[state])
        out += letter
        if used:
            return out, state


@lru_cache(maxsize=1 << 14)
def _short_run(symbol: tuple[str, int], length: int, state: int, to_go: tuple[int, ...]) -> tuple[str, int]:
    if length == 1:
        return one_row(symbol, state, to_go)
    half = 1 << ((length - 1).bit_length() - 1)
    first, state = _short_run(symbol, half, state, run_back(symbol, length - half, to_go))
    rest, state = _short_run(symbol, length - half, state, to_go)
    return first + rest, state


def unroll(symbol: tuple[str, int], length: int, state: int, to_go: tuple[int, ...]) -> Iterator[tuple[str, int]]:
    """Letters of a run in parts, each with the state behind it; long runs are halved, short ones are remembered."""
    if length <= 64:
        least = min(to_go)
        yield _short_run(symbol, length, state, tuple(x - least for x in to_go))
        return
    half = 1 << ((length - 1).bit_length() - 1)
    for part in unroll(symbol, half, state, run_back(symbol, length - half, to_go)):
        state = part[1]
        yield part
    yield from unroll(symbol, length - half, state, to_go)


def plan(runs: list[tuple[tuple[str, int], int]]) -> tuple[int, str]:
    """Least cost and audit of a conversation given as runs (symbol, length)."""
    to_go = [tuple(INSERT * len(x) for x in CLOSING)]
    for symbol, length in reversed(runs):
        to_go.append(run_back(symbol, length, to_go[-1]))
    cost, state, audit = to_go[-1][START], START, []
    for (symbol, length), behind in zip(runs, reversed(to_go[:-1])):
        for letters, state in unroll(symbol, length, state, behind):
            audit.append(letters)
    return cost, "".join(audit) + CLOSING[state]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, live) as the query wants them damaged; a dropped row stays as one that is not live."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
        (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("k"),
    )
    rows = rows.withColumns({
        "text": F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("k") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.select("conv_id", "turn", "role", "text", (F.col("k") != 0).alias("live"))


ORDER = ["turn", "role", "digest"]


def symbols(rows: DataFrame) -> DataFrame:
    """Narrow rows (conv_id, turn, initial, fault, live), sorted inside their task by conversation and turn."""
    live = F.col("live")
    narrow = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "live",
        (~F.col("text").rlike(SPACE.replace("[", "[^", 1))).alias("blank"),
        (~F.right(F.rtrim("text", F.lit(SPACE_CHARS)), F.lit(1)).isin(".", "!", "?")).alias("short"),
    )
    same = Window.partitionBy("conv_id").orderBy("live", "role", "digest", "turn")
    seen = lambda c: F.lag(c).over(same).eqNullSafe(F.col(c))
    marked = narrow.repartition("conv_id").withColumn("again", seen("live") & seen("role") & seen("digest"))
    fault = F.when(~live, "gone").when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("short"), "truncated").otherwise("")
    return marked.sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost and audit."""
    source = symbols(rows)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([source.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in counts], T.StructField("audit", T.StringType())])
    id_type = source.limit(0).toArrow().schema.field("conv_id").type

    class Conversation:
        def __init__(self, conv_id):
            self.conv_id, self.runs, self.last = conv_id, [], None
            self.low = self.high = None
            self.turns = 0
            self.n = dict.fromkeys(counts, 0)

        def add(self, turn, initial, fault):
            if fault == "gone":
                return
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            if fault:
                self.n[fault] += 1
            if self.last is not None and self.last + initial not in LEGAL:
                self.n["illegal"] += 1
            self.last = initial
            kind = GONE if fault in ("blank", "duplicate") else SHORT if fault else SOUND
            symbol = (initial if initial and initial in INITIALS else "x", kind)
            if self.runs and self.runs[-1][0] == symbol:
                self.runs[-1] = (symbol, self.runs[-1][1] + 1)
            else:
                self.runs.append((symbol, 1))

        def row(self):
            self.n["cost"], audit = plan(self.runs)
            self.n["gaps"] = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return [self.conv_id, *self.n.values(), audit]

    def repaired(batches):
        now, out = None, []

        def flush():
            names = [f.name for f in schema.fields]
            types = [id_type, *[pa.int64()] * len(counts), pa.string()]
            columns = list(zip(*out)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            out.clear()
            return batch

        for batch in batches:
            for conv_id, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = Conversation(conv_id)
                now.add(turn, initial, fault)
            yield flush()
        if now is not None:
            out.append(now.row())
        yield flush()

    return source.mapInArrow(repaired, schema)


def planned(rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """Every conversation's plan, then its live rows in order; sorted inside the task, not gathered."""
    texts = rows.filter("live").select("conv_id", F.lit(1).alias("part"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    heads = plan_rows.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
    )
    both = heads.unionByName(texts).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "part", *ORDER).select("conv_id", "part", "role", "text")


def repaired_rows(batches) -> Iterator[list[tuple]]:
    """Per batch of sorted rows: (conversation, edit, role, text) of each repaired row, and (conversation, None, ...) at its start."""
    letters, state, at, conv = "", START, 0, None
    for batch in batches:
        out = []

        def inserts():
            nonlocal at, state
            while at < len(letters) and letters[at] == "I":
                state = NEXT[state]
                out.append((conv, "I", ROLE[state], ""))
                at += 1

        for conv_id, part, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text"))):
            if part == 0:
                letters, state, at, conv = text, START, 0, conv_id
                out.append((conv, None, None, None))
                inserts()
                continue
            edit = letters[at]
            at += 1
            if edit == "K":
                state = kept_state(state, role[:1])
                out.append((conv, edit, role, text))
            elif edit == "R":
                state = NEXT[state]
                out.append((conv, edit, ROLE[state], text))
            inserts()
        yield out


def repair(rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place from 1, edit (K, R or I), role, text."""
    source = planned(rows, plan_rows)
    id_type = source.limit(0).toArrow().schema.field("conv_id").type
    schema = T.StructType([
        source.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])

    def rows_of(batches):
        place = 0
        for found in repaired_rows(batches):
            out = []
            for conv, edit, role, text in found:
                place = 0 if edit is None else place + 1
                if edit is not None:
                    out.append((conv, place, edit, role, text))
            columns = list(zip(*out)) or [()] * 5
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.fieldNames())

    return source.mapInArrow(rows_of, schema)


def digests(rows: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation (``role:text`` lines), fed row by row."""
    source = planned(rows, plan_rows)
    id_type = source.limit(0).toArrow().schema.field("conv_id").type
    schema = T.StructType([source.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def digest(batches):
        now, conv_now, first = None, None, True
        for found in repaired_rows(batches):
            out = []
            for conv, edit, role, text in found:
                if edit is None:
                    if now is not None:
                        out.append((conv_now, now.hexdigest()))
                    now, conv_now, first = hashlib.sha256(), conv, True
                else:
                    now.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            columns = list(zip(*out)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, pa.string()])], schema.fieldNames())
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv_now], id_type), pa.array([now.hexdigest()])], schema.fieldNames())

    return source.mapInArrow(digest, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Plans and digests of damaged rows (conv_id, turn, role, text, live)."""
    found = written(plans(rows), "plans")
    own = digests(rows, found).withColumnRenamed("conv_id", "c")
    return found.join(own, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")


def _add(cost: int, letters: str, then: str) -> str:
    return f"lpad(CAST(CAST(substr({then}, 1, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{letters}' || substr({then}, 13)"


def _row_sql(state: int) -> str:
    """Cheapest way to use up one row from a state, as cost and audit in one string."""
    extra = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    ways = [_add(4, "D", f"h{state}")]
    keeps = {i: kept_state(state, i) for i in INITIALS}
    kept = " ".join(f"WHEN left(role, 1) = '{i}' THEN {_add(extra, 'K', f'h{to}')}" for i, to in keeps.items() if to is not None)
    free = "fault NOT IN ('blank', 'duplicate')"
    ways.append(f"CASE WHEN {free} THEN CASE {kept} END END")
    ways.append(f"CASE WHEN {free} THEN {_add('3 + ' + extra, 'R', f'h{NEXT[state]}')} END")
    return f"least({', '.join(ways)})"


def _step_sql(state: int) -> str:
    a, b = NEXT[state], NEXT[NEXT[state]]
    return f"least(e{state}, {_add(3, 'I', f'e{a}')}, {_add(6, 'II', f'e{b}')})"


SQL12 = rf"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS v FROM (SELECT unnest(range(0, 256)) AS i))),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS k FROM c, tab),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
o AS (SELECT *, row_number() OVER w AS rn, lead(role) OVER w AS next_role,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
    FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_role IS NOT NULL AND left(role, 1) || left(next_role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
g AS (SELECT conv_id, n + 1 AS rn, '000000000000' AS h0, '000000000006II' AS h1, '000000000003I' AS h2, '000000000000' AS h3 FROM n
  UNION ALL
  SELECT conv_id, rn, {_step_sql(0)}, {_step_sql(1)}, {_step_sql(2)}, {_step_sql(3)} FROM (
    SELECT f.conv_id, f.rn, {_row_sql(0)} AS e0, {_row_sql(1)} AS e1, {_row_sql(2)} AS e2, {_row_sql(3)} AS e3
    FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.rn = g.rn - 1)),
p AS (SELECT conv_id, CAST(substr(h0, 1, 12) AS BIGINT) AS cost, substr(h0, 13) AS audit FROM g WHERE rn = 1),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS i FROM p),
m AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS rn, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS kn FROM l),
r AS (SELECT m.*, f.role, CASE WHEN e = 'I' THEN '' ELSE f.text END AS text,
    max(CASE WHEN kn = 1 AND e = 'K' AND left(f.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS s
    FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.rn = m.rn),
t AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (kn - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS t
    FROM r WHERE e <> 'D' GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query(SQL12)
def op12_conversation_repair(spark, sf_dir):
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))
