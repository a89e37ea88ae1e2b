r"""Operator 11, conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A turn is kept (0), given the role user or assistant (1) or deleted (2, and nothing else if it is blank or was seen
before); an empty turn of user or assistant may be inserted anywhere (5); a truncated turn that is not deleted adds 5.
Afterwards the first letters of the roles are nothing, or pairs of u and a after one s at most.

Backwards over the turns a dynamic programme holds the cost to go from each of the grammar's four states, and notes for
every state the ASCII-least edit among those that are tight, that is on a cheapest way. Forwards, a walk from the
first state takes the noted edits; as the edits so far fix the state, its choices are the least audit. Turns are rebuilt on the way and hashed.

A partition holds whole conversations, each sorted twice: without texts from last turn to first, then with them from
first to last. One pass over it does both halves of the work, so a conversation of any length is a stream: a byte a
turn is what is held of it (and its audit, which is a value of the result), never its texts. All of one conversation goes through one task, as a hash over its text
in order has to. Duplicates are found by a window over equal role and text in the same partition, so texts are shuffled once, by conversation.

Defined results: a null role or text is one space; turns are taken in the order of their number, null first, then role,
then SHA-256 of the text. Faults, the first of which counts: blank (no character but space, tab to carriage return), duplicate (role and
text seen earlier in the conversation), truncated (the last other character is none of ``.!?``). A null conversation id is a
conversation of its own. Rows that repeat are turns that repeat. A row that stands 0 times (``copies``) only makes its conversation known:
one without turns has zeros, an empty audit and the hash of nothing. Other columns are not read, whatever their names; an empty table gives none; very long texts pass as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import table, tidy
from ferrule.llm.sql import CRC_TABLE, crc32

BLANKS = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
OTHER, SYSTEM, USER, ASSISTANT = range(4)
#: The grammar: for each state, nothing yet, after s, after u, after a, the state that a turn of each kind leads to.
NEXT = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
LETTERS = b"DIKR"
#: Cost to go after the last turn: what has to be inserted. A start without a system turn goes on with user, as every state does but "after u".
END = (0, 2 * INSERT, INSERT, 0)
SPOKEN = tuple(ASSISTANT if ASSISTANT in n else USER for n in NEXT)


@lru_cache(None)
def before(after: tuple[int, ...], role: int, fault: int) -> tuple[tuple[int, ...], int]:
    """Cost to go from each state before a turn, and the edits to take: two bits a state, an index into ``LETTERS``."""
    ways = []
    for state, leads in enumerate(NEXT):
        way = {0: DELETE + after[state]}
        if fault in (NONE, TRUNCATED):
            left = LEFT_TRUNCATED if fault == TRUNCATED else 0
            way[3] = REROLE + left + after[leads[SPOKEN[state]]]
            if role in leads:
                way[2] = left + after[leads[role]]
        ways.append(way)
    cost = [min(way.values()) for way in ways]
    for _ in NEXT:  # inserts in a row lead through each state once at most
        cost = [min(c, INSERT + cost[leads[SPOKEN[s]]]) for s, (c, leads) in enumerate(zip(cost, NEXT, strict=True))]
    edits = 0
    for state, way in enumerate(ways):
        way[1] = INSERT + cost[NEXT[state][SPOKEN[state]]]
        edits |= min(e for e, c in way.items() if c == cost[state]) << 2 * state
    return tuple(cost), edits


class Conversation:
    """What is held of one conversation while it streams by: costs, a byte a turn, counts, the hash, the audit."""

    def __init__(self, conv) -> None:
        self.conv, self.after, self.base, self.edits = conv, END, 0, bytearray()
        self.faults, self.illegal, self.later, self.most, self.least, self.distinct = [0] * 4, 0, None, None, None, 0
        self.state, self.audit, self.hash, self.rebuilt = 0, bytearray(), hashlib.sha256(), 0

    def backward(self, turn: int | None, role: int, fault: int, copies: int) -> None:
        """The next turn towards the first, with the copies that stand beside it."""
        if turn is not None and turn != self.least:
            self.most, self.least, self.distinct = turn if self.most is None else self.most, turn, self.distinct + 1
        for n in range(copies, 0, -1):
            this = fault if n == 1 or fault == BLANK else DUPLICATE
            self.faults[this] += 1
            self.illegal += self.later is not None and (role, self.later) not in LEGAL
            self.later = role
            cost, edits = before(self.after, role, this)
            low = min(cost)
            self.after, self.base = tuple(c - low for c in cost), self.base + low
            self.edits.append(edits)

    def put(self, edit: int, role: bytes, text: bytes) -> tuple:
        self.hash.update(b"\n" * (self.rebuilt > 0) + role + b":" + text)
        self.rebuilt += 1
        return self.conv, self.rebuilt, chr(LETTERS[edit]), role, text

    def spoken(self, edit: int, text: bytes = b"") -> tuple:
        role = SPOKEN[self.state]
        self.state = NEXT[self.state][role]
        return self.put(edit, NAMES[role].encode(), text)

    def forward(self, kind: int, role: bytes, text: bytes, copies: int) -> Iterator[tuple]:
        """The next turn from the first on: the rebuilt turns that its edits give."""
        while copies:
            edit = self.edits[-1] >> 2 * self.state & 3
            self.audit.append(LETTERS[edit])
            if edit == 1:
                yield self.spoken(edit)
                continue
            self.edits.pop()
            copies -= 1
            if edit == 2:
                self.state = NEXT[self.state][kind]
                yield self.put(edit, role, text)
            elif edit == 3:
                yield self.spoken(edit, text)

    def close(self) -> Iterator[tuple]:
        """The turns to insert after the last one."""
        while END[self.state]:
            self.audit.append(LETTERS[1])
            yield self.spoken(1)

    def account(self) -> tuple:
        gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, self.after[0] + self.base, self.audit.decode(), self.hash.hexdigest()


def fold(accounts: bool) -> Callable[[Iterator], Iterator]:
    """The pass over a sorted partition; returns the accounts of its conversations, or their rebuilt turns."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"] if accounts else ["conv", "n", "edit", "role", "text"]

    def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        kinds = [kind] + ([pa.int64()] * 6 + [pa.string()] * 2 if accounts else [pa.int64()] + [pa.string()] * 3)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, kind = None, [], pa.null()

        def finish() -> None:
            turns = list(now.close())
            rows.extend([now.account()] if accounts else turns)

        for b in batches:
            kind = b.column(0).type
            texts = [b.column(i).cast(pa.binary()).to_pylist() for i in (6, 7)]
            for conv, pos, turn, role, fault, copies, name, text in zip(*(b.column(i).to_pylist() for i in range(6)), *texts, strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        finish()
                    now = Conversation(conv)
                if pos < 0:
                    now.backward(turn, role, fault, copies)
                else:
                    for turned in now.forward(role, name, text, copies):
                        if not accounts:
                            rows.append(turned)
            yield out(rows, kind)
            rows.clear()
        if now is not None:
            finish()
            yield out(rows, kind)

    return run


def fault_of(text: Column, seen: Column) -> Column:
    said = F.rtrim(text, F.lit(BLANKS))
    return F.when(said == "", BLANK).when(seen, DUPLICATE).when(~F.substring(said, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)


def streamed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    """``(conv, pos, turn, kind, fault, copies, role, text)``: each turn twice, from last to first (pos below 0, no text), then from first to last."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    copies = F.lit(1) if copies_col is None else F.coalesce(F.col(copies_col), F.lit(0)).cast("int")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), copies.alias("copies"))
    there = F.when(F.col("copies") > 0, F.col("text"))
    rows = rows.withColumns({"text": there, "turn": F.when(F.col("copies") > 0, F.col("turn")), "digest": F.sha2(there, 256)}).repartition("conv")
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    seen = F.row_number().over(Window.partitionBy("conv", "role", "digest").orderBy("place")) > 1
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("s", SYSTEM, "u", USER, "a", ASSISTANT))), F.substring("role", 1, 1)), F.lit(OTHER))
    known = rows.withColumn("place", place).select("conv", "turn", "role", "text", "copies", fault_of(F.col("text"), seen).alias("fault"), kind.alias("kind"), "place")
    back = F.struct((-F.col("place")).alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    ahead = F.struct(F.col("place").alias("pos"), "role", F.coalesce("text", F.lit("")).alias("text"))
    twice = known.select("conv", "turn", "kind", "fault", "copies", F.explode(F.array(back, ahead)).alias("as"))
    return twice.select("conv", F.col("as.pos").alias("pos"), "turn", "kind", "fault", "copies", F.col("as.role").alias("role"), F.col("as.text").alias("text")).sortWithinPartitions("conv", "pos")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """``(conv, n, edit, role, text)``: the rebuilt turns, numbered from 1, with the edit that gave each."""
    shape = T.StructType([T.StructField("conv", turns.schema[conv_col].dataType), *(T.StructField(n, k) for n, k in (("n", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())))])
    return streamed(turns, conv_col, turn_col, role_col, text_col, copies_col).mapInArrow(fold(False), shape).withColumnRenamed("conv", conv_col)


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation."""
    longs = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    shape = T.StructType([T.StructField("conv", turns.schema[conv_col].dataType), *longs, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return streamed(turns, conv_col, turn_col, role_col, text_col, copies_col).mapInArrow(fold(True), shape).withColumnRenamed("conv", conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by a hash of conversation and turn; ``copies`` is how often a turn stands, 0 if it is dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("damage"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1).alias("copies"),
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, after damage."""
    return audits(damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


def _more(v: str, cost: str, letter: str) -> str:
    """SQL: a way ``v``, nine digits of cost and then the edits, with one more edit in front."""
    return f"lpad((CAST(left({v}, 9) AS BIGINT) + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({v}, 10)"


def _ways(state: int) -> str:
    """SQL: the least way from a state over the edits of the turn itself; a way is comparable as text, by cost and then by edits."""
    leads, spoken = NEXT[state], NEXT[state][SPOKEN[state]]
    keep = " ".join(f"WHEN initial = '{' sua'[kind]}' THEN {_more(f'v{to}', 'kept', 'K')}" for kind, to in leads.items())
    return f"least({_more(f'v{state}', str(DELETE), 'D')}, CASE WHEN fault IN ({NONE}, {TRUNCATED}) THEN {_more(f'v{spoken}', f'kept + {REROLE}', 'R')} END, CASE WHEN fault IN ({NONE}, {TRUNCATED}) THEN CASE {keep} END END)"


OP11_SQL = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage FROM conversations, {CRC_TABLE}),
rows AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE damage WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM base),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM rows),
said AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stem, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
turns AS (SELECT *, CASE WHEN stem = '' THEN {BLANK} WHEN seen THEN {DUPLICATE} WHEN right(stem, 1) NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE {NONE} END AS fault FROM said),
counts AS (
  SELECT c.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = {BLANK}) AS blank,
         count(*) FILTER (fault = {DUPLICATE}) AS duplicate, count(*) FILTER (fault = {TRUNCATED}) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN turns t ON c.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY c.conv_id),
dp(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {', '.join(f"'{c:09d}{'I' * (c // INSERT)}'" for c in END)} FROM counts
  UNION ALL
  SELECT conv_id, i, least(r0, {_more('w2', str(INSERT), 'I')}), least(r1, {_more('w2', str(INSERT), 'I')}), w2, w3 FROM (
    SELECT *, least(r2, {_more('r3', str(INSERT), 'I')}) AS w2, least(r3, {_more('r2', str(INSERT), 'I')}) AS w3 FROM (
      SELECT conv_id, i, {', '.join(f'{_ways(s)} AS r{s}' for s in range(4))} FROM (
        SELECT t.*, v0, v1, v2, v3, CASE fault WHEN {TRUNCATED} THEN {LEFT_TRUNCATED} ELSE 0 END AS kept
        FROM dp JOIN turns t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.i = dp.i - 1)))),
best AS (SELECT conv_id, CAST(left(v0, 9) AS BIGINT) AS cost, substr(v0, 10) AS audit FROM dp WHERE i = 1),
letters AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> ''),
steps AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o FROM letters
  WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
edits AS (
  SELECT s.*, role, text, max(s.o = 1 AND s.letter = 'K' AND initial = 's') OVER (PARTITION BY s.conv_id) AS led
  FROM steps s LEFT JOIN turns t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.i = t.i WHERE s.letter <> 'D'),
rebuilt AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM edits GROUP BY conv_id)
SELECT c.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM counts c JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN rebuilt r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""
