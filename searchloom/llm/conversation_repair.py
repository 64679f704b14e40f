"""Conversation structure repair: cheapest edits by a rank-convergence parallel Viterbi.

Turns of a conversation, in order, must read ``(s?(ua)+)?`` by the initials of their roles. A row may be
kept (0), given the role user or assistant (2) or deleted (3; blank and repeated rows must be), and an
empty turn may be inserted anywhere (2); a truncated row that stays adds 1. Four states (nothing yet,
after s, after u, after a) make this a shortest path. The least audit (the initials of the edits, in
order) is found from the front, with the costs to the end known, so the costs are computed backwards.

Parallel Viterbi. Rows are range-partitioned and sorted by conversation and turn, and cut into chunks
of at most ``CHUNK`` rows; a conversation that a task sees from its first row to its last is done there
and then, as one chunk. Of other conversations, however long, every chunk starts from a speculative
cost vector behind its last row. Fix-up passes then rerun the chunks whose vector differs from the one
that their follower has found by more than a constant, until none does. Constants do not matter: cost
vectors are taken less their least cost, of which a chunk's steps can reach but a few (``VECTORS``).
Rows that never converge (a long run of user turns has two phases) would need one pass a chunk: after
``PASSES`` passes the rest get their whole map of vectors, and maps are composed by doubling. With the
vectors behind all chunks known, the traces from each state are composed the same way, and every chunk
is traced once more from its true state. Costs of a conversation are the sum of its chunks' constants.

Spark. A chunk's edits are one byte a row; texts are read again only for the last trace. All joins are
by a chunk's running number, so no conversation is a hot key. At the end the pieces of a conversation
of many chunks come together, in order, in one task that holds one batch, as SHA-256 runs from front to
end; its audit is one string of the result.

Edge cases. A null conversation is one of its own; null roles and texts are one space, null turns come
first and count in no gap. Rows of one turn are in order of role and text (their first 64 characters,
then a hash). Repeated rows are duplicates. A conversation that loses all rows has zeros and the hash of
nothing. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, read, small_batches, stored_at

CHUNK, CHARACTERS, PASSES = 256, 1 << 20, 3
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: State after a kept row, by its initial; state and role that a new or changed turn leads to.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FILLED, FILLER = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Row codes: the initial (s, u, a, other) doubled, and one more if truncated; or to be deleted.
INITIALS, FORCED = "sua", 8
#: Costs behind the last row, and what chunks start from that are not the last.
END, GUESS = (0, 4, 2, 0), (0, 0, 0, 0)


def before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row, from those behind it."""
    row = []
    for q in range(4):
        options = [DELETE + after[q]]
        if code != FORCED:
            cut = TRUNCATED * (code % 2)
            options.append(REROLE + cut + after[FILLED[q]])
            kept = KEPT.get("sua-"[code // 2], {}).get(q)
            if kept is not None:
                options.append(KEEP + cut + after[kept])
        row.append(min(options))
    user, assistant = min(row[2], INSERT + row[3]), min(row[3], INSERT + row[2])
    return min(row[0], INSERT + user), min(row[1], INSERT + user), user, assistant


def _reachable() -> tuple[list[tuple[int, ...]], list[list[int]], list[list[int]]]:
    """All cost vectors less their least cost, and by code and vector the next vector and constant."""
    found, steps, constants = [END, GUESS], [[] for _ in range(FORCED + 1)], [[] for _ in range(FORCED + 1)]
    for after in found:
        for code in range(FORCED + 1):
            costs = before(code, after)
            least = min(costs)
            vector = tuple(c - least for c in costs)
            if vector not in found:
                found.append(vector)
            steps[code].append(found.index(vector))
            constants[code].append(least)
    return found, steps, constants


VECTORS, STEPS, CONSTANTS = _reachable()


def backward(codes: bytes, end: int) -> tuple[list[int], int]:
    """The vectors behind each row and, first, before all; and the sum of the constants."""
    ids, total, v = [end], 0, end
    for code in reversed(codes):
        total += CONSTANTS[code][v]
        v = STEPS[code][v]
        ids.append(v)
    ids.reverse()
    return ids, total


@cache
def edits(code: int, behind: int, q: int) -> tuple[str, int]:
    """The least audit that takes one row, and the state behind it."""
    after, audit = VECTORS[behind], ""
    costs = before(code, after)
    cut = TRUNCATED * (code % 2)
    while True:
        kept = KEPT.get("sua-"[code // 2], {}).get(q) if code != FORCED else None
        if DELETE + after[q] == costs[q]:
            return audit + "D", q
        if INSERT + costs[FILLED[q]] == costs[q]:
            audit, q = audit + "I", FILLED[q]
        elif kept is not None and KEEP + cut + after[kept] == costs[q]:
            return audit + "K", kept
        else:
            return audit + "R", FILLED[q]


def traced(codes: bytes, ids: list[int], q: int, last: bool) -> tuple[list[str], int]:
    """The edits of each row (inserted turns before it) from state ``q``, of a last chunk also what is
    inserted at the end; and the state behind."""
    out = []
    for at, code in enumerate(codes):
        own, q = edits(code, ids[at + 1], q)
        out.append(own)
    if last:
        tail = ""
        while q not in (0, 3):
            tail, q = tail + "I", FILLED[q]
        out.append(tail)
    return out, q


def repaired(roles: list[str], texts: list[str], audits: list[str], q: int) -> list[str]:
    """The turns that the edits give, as ``role:text``."""
    lines = []
    for at, own in enumerate(audits):
        for edit in own:
            if edit == "I":
                lines.append(FILLER[q] + ":")
                q = FILLED[q]
            elif edit == "K":
                lines.append(f"{roles[at]}:{texts[at]}")
                q = KEPT[roles[at][0]][q]
            elif edit == "R":
                lines.append(f"{FILLER[q]}:{texts[at]}")
                q = FILLED[q]
    return lines


def digest(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def coded(roles: list[str], texts: list[str], seen: set) -> tuple[bytes, int, int, int]:
    """A code for each row; blank, duplicate and truncated rows. ``seen`` gets what occurs."""
    codes, blank, again, cut = bytearray(), 0, 0, 0
    for role, text in zip(roles, texts, strict=True):
        key, plain = digest(role, text), text.rstrip(SPACES)
        if not plain:
            blank += 1
            codes.append(FORCED)
        elif key in seen:
            again += 1
            codes.append(FORCED)
        else:
            short = plain[-1] not in ".!?"
            cut += short
            codes.append(2 * (INITIALS.find(role[0]) if role and role[0] in INITIALS else 3) + short)
        seen.add(key)
    return bytes(codes), blank, again, cut


class Tally:
    """Faults, gaps and illegal neighbours of a conversation, over its rows or its chunks in order."""

    def __init__(self):
        self.blank = self.again = self.cut = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.initial = None

    def add(self, roles: list[str], turns: list[int | None], faults: tuple[int, int, int]) -> None:
        self.blank, self.again, self.cut = (x + y for x, y in zip((self.blank, self.again, self.cut), faults, strict=True))
        for role, turn in zip(roles, turns, strict=True):
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in LEGAL
            self.initial = role[:1]
            if turn is not None:
                self.turns += turn != self.turn
                self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn

    def row(self) -> tuple[int, int, int, int, int]:
        return (0 if self.low is None else self.high - self.low + 1 - self.turns), self.blank, self.again, self.cut, self.illegal


FIELDS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
PIECES = "part int, idx int, turns array<bigint>, roles array<string>, texts array<string>"


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after damage. A dropped row stays, marked ``gone`` and
    without a text, so that its conversation is known."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn"))) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(kind == 4, "user").otherwise(some("role")).alias("role"),
        text.alias("text"), (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    ).drop("col")


def _first_pass(rows: DataFrame, chunk: int) -> DataFrame:
    """Results of conversations that lie within a task, and chunks of the others (``idx``: their number
    in the partition, -1 if without rows)."""
    conv = dict(rows.dtypes)["conv_id"]
    keys = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text"), "__at"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows differ in __at alone, so that any number of them can be dealt to several tasks
    held = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    held = held.select("conv_id", "turn", "role", "text", "gone", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out, part = None, [], None
        roles, texts, turns, size = [], [], [], 0
        current, number, whole = None, 0, False  # (conv_id,), chunks so far, whether it began here and has no chunk yet

        def flush(open_: bool) -> tuple:
            nonlocal number, size
            if open_:
                row = (current[0], *[None] * 8, part, number if roles else -1, list(turns), list(roles), list(texts))
                number += bool(roles)
            else:
                codes, *faults = coded(roles, texts, set())
                tally = Tally()
                tally.add(roles, turns, tuple(faults))
                ids, cost = backward(codes, 0)
                audits, _ = traced(codes, ids, 0, True)
                lines = "\n".join(repaired(roles, texts, audits, 0))
                row = (current[0], *tally.row(), cost + VECTORS[ids[0]][0], "".join(audits), hashlib.sha256(lines.encode()).hexdigest(), *[None] * 5)
            for held in (roles, texts, turns):
                held.clear()
            size = 0
            return row

        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, *_types(RESULT), *_types(PIECES)]
            for conv, turn, role, text, gone, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current != (conv,):
                    if current is not None:
                        if whole or roles or marked:
                            out.append(flush(not whole))
                        whole = True
                    current, part, marked = (conv,), own, True
                elif len(roles) >= chunk or size >= CHARACTERS:
                    out.append(flush(True))
                    whole = marked = False
                if not gone:
                    roles.append(role)
                    texts.append(text)
                    turns.append(turn)
                    size += len(role) + len(text)
            if len(out) >= 64:
                yield _batch(out, names, kinds)
                out = []
        if current is not None:
            if whole or roles or marked:
                out.append(flush(True))
            yield _batch(out, names, kinds)

    schema = f"conv_id {conv}, {RESULT}, {PIECES}"
    names = [c.split()[0] for c in schema.split(", ")]
    return held.mapInArrow(run, schema)


def _per_chunk(rows: DataFrame, made, schema: str) -> DataFrame:
    """``made(row)`` (a tuple) of each row, given as a dict."""
    names, kinds = [c.split()[0] for c in schema.split(", ")], _types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([made(r) for r in batch.to_pylist()], names, kinds)

    return rows.mapInArrow(run, schema)


def composed(maps: DataFrame, step: int) -> DataFrame:
    """``n, value``: the maps (n, map, done) of row ``n`` and of those ``step`` apart before it, applied
    in their order from one that is ``done`` (all its entries are equal), by doubling."""
    while maps.filter("NOT done").limit(1).count():
        other = maps.select((F.col("n") - step).alias("n"), F.col("map").alias("far"), F.col("done").alias("far_done"))
        joined = maps.join(other, "n", "left")
        through = F.transform("far", lambda x: F.col("map")[x])
        maps = materialize(
            joined.select(
                "n", F.when(F.col("done") | F.col("far").isNull(), F.col("map")).otherwise(through).alias("map"),
                (F.col("done") | F.coalesce("far_done", F.lit(True))).alias("done"),
            ),
            "composed",
        )
        step *= 2
    return maps.select("n", F.col("map")[0].alias("value"))


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with ``n``, their number over all partitions; broadcast is one row for each partition."""
    counts = chunks.groupBy("part").agg(F.count(F.lit(1)).alias("own"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("of"), F.coalesce(F.sum("own").over(above), F.lit(0)).alias("start"))
    return chunks.join(F.broadcast(starts), F.col("part") == F.col("of")).withColumn("n", F.col("start") + F.col("idx")).drop("of", "start")


def _named(conv: str = "conv_id") -> Column:
    return F.concat(F.when(F.col(conv).isNull(), "n").otherwise("v"), F.coalesce(F.col(conv).cast("string"), F.lit("")))


def _coded(chunks: DataFrame) -> DataFrame:
    """``n, key, codes, first, last`` and the faults of each chunk; rows that an earlier chunk of the
    conversation has are duplicates too."""
    one = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.sha2(F.concat(F.length(x["roles"]).cast("string"), F.lit(":"), x["roles"], x["texts"]), 256))
    named = chunks.withColumn("key", _named())
    spread = materialize(named.select("n", "key", F.explode(F.array_distinct(one)).alias("digest")), "digests")
    firsts = spread.groupBy("key", "digest").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    earlier = spread.join(firsts, ["key", "digest"]).filter("n > first").groupBy("n").agg(F.collect_list("digest").alias("seen"))

    def made(row: dict) -> tuple:
        codes, *faults = coded(row["roles"], row["texts"], set(row["seen"] or ()))
        return row["n"], row["key"], codes, *faults

    table = materialize(
        _per_chunk(named.join(earlier, "n", "left").select("n", "key", "roles", "texts", "seen"), made, "n bigint, key string, codes binary, blank bigint, again bigint, cut bigint"), "coded"
    )
    near = lambda by, name: table.select((F.col("n") + by).alias("n"), F.col("key").alias(name))
    edged = table.join(near(-1, "after"), "n", "left").join(near(1, "above"), "n", "left")
    same = lambda c: F.coalesce(F.col(c) == F.col("key"), F.lit(False))
    return materialize(edged.select(*table.columns, (~same("above")).alias("first"), (~same("after")).alias("last")), "edged")


def _ends(table: DataFrame, passes: int) -> DataFrame:
    """``n, end``: the vector behind each chunk."""
    guess = VECTORS.index(GUESS)

    def begun(row: dict) -> tuple:
        end = 0 if row["last"] else guess
        return row["n"], row["last"], end, backward(row["codes"], end)[0][0], True

    def rerun(row: dict) -> tuple:
        if row["given"] == row["end"]:
            return row["n"], row["last"], row["end"], row["top"], False
        top = backward(row["codes"], row["given"])[0][0]
        return row["n"], row["last"], row["given"], top, top != row["top"]

    schema = "n bigint, last boolean, end int, top int, changed boolean"
    state = materialize(_per_chunk(table.select("n", "last", "codes"), begun, schema), "speculated")
    given = lambda s: F.when(F.col("last"), 0).otherwise(F.col("given")).alias("given")
    for _ in range(passes):
        told = state.select((F.col("n") - 1).alias("n"), F.col("top").alias("given"))
        asked = state.join(told, "n", "left").select("n", "last", "end", "top", given(state)).join(table.select("n", "codes"), "n")
        state = materialize(_per_chunk(asked, rerun, schema), "fixed")
        if not state.filter("changed").limit(1).count():
            return state.select("n", "end")

    def mapped(row: dict) -> tuple:
        ends = [0] * len(VECTORS) if row["last"] else range(len(VECTORS))
        return row["n"], [backward(row["codes"], e)[0][0] for e in ends], row["last"]

    maps = materialize(_per_chunk(table.select("n", "last", "codes"), mapped, "n bigint, map array<int>, done boolean"), "maps")
    tops = composed(maps, 1).select((F.col("n") - 1).alias("n"), F.col("value").alias("given"))
    return table.select("n", "last").join(tops, "n", "left").select("n", given(table).cast("int").alias("end"))


def repair(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, gone): its faults, the cost
    and audit of its repair, and the digest of the repaired turns."""
    spark = rows.sparkSession
    small_batches(spark)
    table = stored_at(_first_pass(rows, chunk), fresh_path(spark, "conversations"))
    done = table.filter("part IS NULL").select(*FIELDS)
    pieces = table.filter("part IS NOT NULL").select("conv_id", "part", "idx", "turns", "roles", "texts")
    chunks = _numbered(pieces.filter("idx >= 0"))
    codes = _coded(chunks)
    ended = materialize(codes.join(_ends(codes, passes), "n"), "ended")

    def through(row: dict) -> tuple:
        ids, _ = backward(row["codes"], row["end"])
        starts = [0] * 4 if row["first"] else range(4)
        return row["n"], [traced(row["codes"], ids, q, False)[1] for q in starts], row["first"]

    maps = materialize(_per_chunk(ended.select("n", "first", "codes", "end"), through, "n bigint, map array<int>, done boolean"), "states")
    entries = composed(maps, -1).select((F.col("n") + 1).alias("n"), F.col("value").alias("entry"))
    whole = chunks.join(ended, "n").join(entries, "n", "left")
    whole = whole.withColumn("entry", F.when(F.col("first"), 0).otherwise(F.col("entry")))

    def final(row: dict) -> tuple:
        ids, cost = backward(row["codes"], row["end"])
        audits, _ = traced(row["codes"], ids, row["entry"], row["last"])
        lines = repaired(row["roles"], row["texts"], audits, row["entry"])
        cost += VECTORS[ids[0]][0] if row["first"] else 0
        initials = [r[:1] for r in row["roles"]]
        return row["n"], row["key"], row["turns"], initials, row["blank"], row["again"], row["cut"], cost, "".join(audits), "\n".join(lines) if lines else None

    kept = whole.select("n", "key", "turns", "roles", "texts", "codes", "end", "entry", "first", "last", "blank", "again", "cut")
    schema = "n bigint, key string, turns array<bigint>, initials array<string>, blank bigint, again bigint, cut bigint, cost bigint, audit string, lines string"
    traces = materialize(_per_chunk(kept, final, schema), "traces")
    known = pieces.select("conv_id", _named().alias("key")).distinct()
    joined = _joined(traces)
    empty = [F.coalesce(c, F.lit(0)).alias(c) for c in FIELDS[1:7]]
    nothing = hashlib.sha256(b"").hexdigest()
    rest = known.join(joined, "key", "left").select("conv_id", *empty, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
    return done.unionByName(rest)


def _joined(traces: DataFrame) -> DataFrame:
    """The chunks of each conversation put together, in order."""
    n = int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = traces.repartition(n, "key").sortWithinPartitions("key", "n")
    schema = f"key string, {RESULT}"
    names, kinds = [c.split()[0] for c in schema.split(", ")], _types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def told() -> tuple:
            return key, *tally.row(), cost, "".join(audit), sha.hexdigest()

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        out.append(told())
                    key, tally, cost, audit, sha, begun = r["key"], Tally(), 0, [], hashlib.sha256(), False
                tally.add(r["initials"], r["turns"], (r["blank"], r["again"], r["cut"]))
                cost += r["cost"]
                audit.append(r["audit"])
                if r["lines"] is not None:
                    sha.update((("\n" if begun else "") + r["lines"]).encode())
                    begun = True
            yield _batch(out, names, kinds)
        if key is not None:
            yield _batch([told()], names, kinds)

    return held.mapInArrow(run, schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same by a recursive query that goes through each conversation from its end."""
    text, role = "coalesce(text, ' ')", "coalesce(role, ' ')"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    made = lambda add, edit, b, line: f"{{'c': b{b}.c + {add}, 'a': '{edit}' || b{b}.a, 'l': {line}b{b}.l}}"
    options = []
    for q in range(4):
        own = [made(DELETE, "D", q, "")]
        own += [f"CASE WHEN NOT forced AND ini = '{i}' THEN {made('cut', 'K', t, "role || ':' || text || chr(10) || ")} END" for i, t in keep[q].items()]
        filled = f"'{FILLER[q]}:' || text || chr(10) || "
        own.append(f"CASE WHEN NOT forced THEN {made(f'cut + {REROLE}', 'R', FILLED[q], filled)} END")
        options.append(f"list_min([{', '.join(own)}]) AS a{q}")
    add = lambda q, x: f"{{'c': {x}.c + {INSERT}, 'a': 'I' || {x}.a, 'l': '{FILLER[q]}:' || chr(10) || {x}.l}}"
    user = f"list_min([a2, {add(2, 'a3')}])"
    return f"""WITH RECURSIVE given AS (SELECT conv_id, turn::BIGINT AS turn, {role} AS role, {text} AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {crc} % 20 AS kind FROM given),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
 CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
 rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS MATERIALIZED (SELECT *, left(role, 1) AS ini, plain = '' AS blank, plain <> '' AND nth > 1 AS again,
 CASE WHEN plain <> '' AND nth = 1 AND right(plain, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut, plain = '' OR nth > 1 AS forced FROM placed),
totals AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
 CAST(sum(cut) AS BIGINT) AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
walk AS (SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': '', 'l': ''}} AS b0, {{'c': 4::BIGINT, 'a': 'II', 'l': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS b1,
 {{'c': 2::BIGINT, 'a': 'I', 'l': 'assistant:' || chr(10)}} AS b2, {{'c': 0::BIGINT, 'a': '', 'l': ''}} AS b3 FROM totals
 UNION ALL SELECT conv_id, i, list_min([a0, {add(0, user)}]), list_min([a1, {add(1, user)}]), {user}, list_min([a3, {add(3, 'a2')}]) FROM (
 SELECT w.conv_id, w.i - 1 AS i, {", ".join(options)} FROM walk w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i)),
ends AS (SELECT conv_id, b0 FROM walk WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(b0.c, 0) AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(left(b0.l, length(b0.l) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


SQL = _sql()
