"""Conversation structure repair against a search over all edits, and on odd input."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ferrule.llm import turn_repair
from ferrule.llm.common import table

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def first_faults(rows):
    """(role, text, fault) of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        out.append((role, text, "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least (cost, audit) of all edits of ``first_faults`` rows that give an allowed order, and the rebuilt turns: uniform-cost search, no grammar states."""
    ahead = re.compile(r"(s?(ua)*u?)?")
    heap = [(0, "", 0, ())]
    most = 2 * len(rows) + 6 * len(rows) + 10
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in out)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, out
        nexts = [(5, "I", 0, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            nexts.append((2, "D", 1, None))
            if fault not in ("blank", "duplicate"):
                left = 5 if fault == "truncated" else 0
                nexts += [(left, "K", 1, (role, text)), *((1 + left, "R", 1, (r, text)) for r in ("user", "assistant"))]
        for c, letter, step, turn in nexts:
            whole = out if turn is None else (*out, turn)
            if cost + c <= most and all(len(r) > 0 for r, _ in whole) and ahead.fullmatch("".join(r[:1] for r, _ in whole)):
                heapq.heappush(heap, (cost + c, audit + letter, at + step, whole))


def account(rows):
    """What ``audits`` returns for rows (turn, role, text) in order, from scratch."""
    found = first_faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = cheapest(found)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    pairs = list(zip(rows, rows[1:], strict=False))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, _, f in found) for k in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def test_audits_against_search(spark):
    """Every conversation of up to five turns from a small alphabet of roles and texts, among them what the grammar does not know."""
    draw = random.Random(11)
    data, expected = [], {}
    for conv in range(400):
        rows = []
        for turn in range(draw.randrange(1, 6)):
            role = draw.choice(["user", "assistant", "assistant", "user", "system", "tool", "User", ""])
            rows.append((draw.choice([None, turn, turn, turn * 2]), role, draw.choice(["Yes.", "No!", "so", " \t", "", "Why? ", "é."])))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        data += [(conv, *r) for r in rows]
        expected[conv] = account(rows)
    draw.shuffle(data)
    df = spark.createDataFrame(data, TURNS)
    assert {r[0]: tuple(r)[1:] for r in turn_repair.audits(df).collect()} == expected
    turns = {}
    for r in sorted(turn_repair.repair(df).collect()):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in turns.items()} == {c: e[-1] for c, e in expected.items() if e[-1] != hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_search(spark, sf):
    """The query's whole table: damage, faults, edits and hash by plain loops."""
    rows, expected = {}, {}
    for r in table(spark, f"/root/testdata/{sf}", "conversations").collect():
        own, damage = rows.setdefault(r.conv_id, []), zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = r.role, r.text
        if damage == 1:
            text = ""
        elif damage == 2:
            text = re.sub("[.!?]", "", text)
        elif damage == 4:
            role = "user"
        own += [(r.turn, role, text)] * {0: 0, 3: 2}.get(damage, 1)
    for conv, own in rows.items():
        own.sort(key=lambda r: r[0])
        expected[conv] = account(own)
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.op11_turn_repair(spark, f"/root/testdata/{sf}").collect()}
    assert got == expected


def test_a_long_conversation_streams_in_small_batches(spark):
    """Thousands of turns of one conversation, cut into batches of 7 rows, with the turns of others around it."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(4000)]
    data = [(1, *r) for r in rows] + [(c, 0, "user", "Hi.") for c in range(2, 30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.conv_id: r for r in turn_repair.audits(spark.createDataFrame(data, TURNS)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got[1].audit == "K" * 4000 and got[1].cost == 0
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in rows).encode()).hexdigest()
    assert all(got[c].audit == "D" and got[c].cost == 2 for c in range(2, 30))


def test_odd_input(spark):
    long = "word " * 200_000
    data = [
        (1, None, None, None, "x"), (1, 3, "user", None, "x"), (1, None, "assistant", "Yes.", "x"),
        (None, 0, "user", "A?", "x"), (None, 1, "assistant", long + ".", "x"), (None, None, None, None, None),
        (2, 0, "user", "Same.", "y"), (2, 0, "user", "Same.", "y"), (2, 0, "user", "Same.", "y"),
        (3, 5, "user", " " * 100_000, "z"), (4, -2, "system", "S.", None), (4, 9, "ünknown", "ü.", None),
    ]
    df = spark.createDataFrame(data, f"{TURNS}, copies string").withColumns({"place": F.lit(1), "fault": F.lit(None), "conv": F.lit("clash"), "pos": F.lit(0)})
    expected = {}
    for conv in {r[0] for r in data}:
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x, _ in data if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        expected[conv] = account(own)
    assert {r[0]: tuple(r)[1:] for r in turn_repair.audits(df).collect()} == expected
    rebuilt = turn_repair.repair(df).where("conv_id IS NULL").orderBy("n").collect()
    assert [(r.edit, r.role, len(r.text)) for r in rebuilt] == [("K", "user", 2), ("K", "assistant", len(long) + 1)]
    gone = turn_repair.audits(spark.createDataFrame([(7, 1, "user", "A.", 0), (8, 1, "user", "A.", None)], f"{TURNS}, copies int"), copies_col="copies").collect()
    assert {tuple(r) for r in gone} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (7, 8)}
    assert turn_repair.audits(df.limit(0)).count() == turn_repair.repair(df.limit(0)).count() == 0
