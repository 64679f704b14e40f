"""Repairs against a plain search over all edits, over chunks of any size."""

import binascii
import hashlib
import random
import re
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from searchloom.llm import conversation_repair as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, x int, col int"


def hurt(rows):
    """Damaged rows of each conversation, by turn."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def plain(rows):
    """Faults and the cheapest repair of one conversation, by recursion over edits and states."""
    seen, forced, cut, count = set(), [], [], [0, 0, 0]
    for _, role, text in rows:
        bare = text.strip(C.SPACES)
        kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
        if kind < 3:
            count[kind] += 1
        seen.add((role, text))
        forced.append(kind < 2)
        cut.append(kind == 2)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserted=0):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            for to in after[state].values():
                if to in names:
                    c, a, lines = best(i, to, inserted + 1)
                    options.append((c + 2, "I" + a, (names[to] + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, lines = best(i + 1, state)
            options.append((c + 3, "D" + a, lines))
            if not forced[i]:
                if role[:1] in after[state]:
                    c, a, lines = best(i + 1, after[state][role[:1]])
                    options.append((c + cut[i], "K" + a, (f"{role}:{text}", *lines)))
                for to in after[state].values():
                    if to in names:
                        c, a, lines = best(i + 1, to)
                        options.append((c + 2 + cut[i], "R" + a, (f"{names[to]}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    for i in range(len(rows), 0, -8):
        for q in after:
            best(i, q)
    cost, audit, lines = best(0, "")
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def made(rng, conv, n, roles, texts):
    return [(conv, rng.choice((i, i, i, i + 1, None)), rng.choice(roles), rng.choice(texts), 1, 2) for i in range(n)]


def conversations():
    rng, rows = random.Random(5), []
    roles, texts = ["user", "assistant", "system", "tool", None, "", "usr"], ["A b.", "b!", "cut", "", " \t", None, "c?", "d. ", "é\x0b", "x", "y.", "z", "q.", "r!"]
    for conv in [None, *range(40)]:
        rows += made(rng, conv, rng.choice((1, 2, 5, 9)), roles, texts)
    for conv in (100, 101):  # long ones
        rows += made(rng, conv, 150, ["user", "assistant"], [f"text {i}." for i in range(100)] + texts)
    rows += [(102, i, "user", f"only users {i}.", 1, 2) for i in range(90)]  # two phases that never converge
    rows += [(103, i, "user", "", 1, 2) for i in range(60)] + [(103, 60, "user", "last.", 1, 2)]  # nothing but deletions
    rows += [(104, i, ("system", "user", "assistant")[min(i, 1 + (i - 1) % 2)], f"fine {i}.", 1, 2) for i in range(81)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, passes, parts", [(256, 3, 4), (4, 3, 3), (3, 1, 5), (1, 0, 2), (7, 100, 4)])
def test_repair(spark, chunk, passes, parts):
    rows = conversations()
    want = {c: plain(own) for c, own in hurt([r[:4] for r in rows]).items()}
    df = C.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r[0]: tuple(r)[1:] for r in C.repair(df, chunk, passes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {c: (want[c], got.get(c)) for c in want if got.get(c) != want[c]} == {} and len(got) == len(want)


def test_vectors_are_few_and_fix_ups_converge(spark):
    assert len(C.VECTORS) < 30
    turns = bytes([2, 4] * 500)  # u a u a ...: any two vectors meet within a few rows
    assert len({C.backward(turns, v)[0][0] for v in range(len(C.VECTORS))}) == 1
    users = bytes([2] * 500)
    assert len({C.backward(users, v)[0][0] for v in range(len(C.VECTORS))}) > 1


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_twin(spark, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{table}/conversations.parquet'")
    df = C.op13_conversation_repair(spark, f"/root/testdata/{table}")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({C.SQL})").fetchall()
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(want) and len({r[7] for r in got}) > 5


def test_empty_and_all_gone(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(i for i in range(1000) if binascii.crc32(f"{i}:0".encode()) % 20 == 0)
    found = C.repair(C.damaged(spark.createDataFrame([(gone, 0, "user", "x.", 1, 1)], SCHEMA))).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_in_many_tasks(spark):
    """Equal rows of one conversation are dealt to several tasks, and its chunks too."""
    rows = spark.range(5000).select(
        F.lit(None).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("same.").alias("text")
    )
    found = C.repair(C.damaged(rows), chunk=64).collect()[0]
    again = 5000 * (2 if binascii.crc32(b" : ") % 20 == 3 else 1) - 1
    assert (found["duplicate"], found["cost"], found["audit"].count("D")) == (again, 3 * again + 2, again)
