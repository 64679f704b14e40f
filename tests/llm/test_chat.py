"""Tool-call linking: orders, validation, orphans and canonical JSON."""

import json
import random

from pyspark.sql import functions as F

from searchloom.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments map<string,string>, depends_on array<string>"


def link(spark, calls, results):
    c = spark.createDataFrame(calls, CALLS)
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    s = spark.createDataFrame(
        [("find", "q", "string", True), ("find", "n", "integer", False), ("stop", "now", "boolean", False)],
        "name string, param string, type string, required boolean",
    )
    return {(x["conv_id"], x["call_id"]): x for x in chat.link_tool_calls(c, r, s).collect()}


def test_links(spark):
    calls = [
        (1, "a", 1, "find", {"q": '"x"', "n": "3"}, []),
        (1, "b", 1, "find", {"q": '"\\"é\\n"'}, ["a"]),
        (1, "c", 1, "find", {"q": '"z"'}, ["b", "a"]),
        (1, "d", 3, "find", {"n": '"3"', "w": "1"}, ["c"]),
        (1, "e", 3, "gone", {}, []),
        (1, "f", 2, "stop", {"now": "true"}, ["d"]),  # on a later turn
        (1, "g", 4, "stop", {}, ["h"]),
        (1, "h", 4, "stop", {}, ["g"]),  # a cycle
        (2, "a", 1, "stop", {}, None),
        (2, "a", 1, "stop", {}, None),  # repeated
        (3, "a", 1, "stop", {}, ["nowhere"]),
    ]
    results = [(1, "a", 2, 'said "x"\n'), (1, "b", 2, None), (1, "c", 2, ""), (2, "a", 2, "one"), (2, "a", 3, "two"), (9, "z", 1, "alone")]
    got = link(spark, calls, results)
    assert [got[1, x]["level"] for x in "abcd"] == [0, 1, 2, 0]
    assert [got[1, x]["status"] for x in "abcdefgh"] == ["ok", "ok", "ok", "invalid", "invalid", "bad_dependency", "bad_dependency", "bad_dependency"]
    assert got[1, "d"]["errors"] == "missing q,type n,unknown w" and got[1, "e"]["errors"] == "unknown tool"
    assert got[3, "a"]["status"] == "bad_dependency" and got[9, "z"]["status"] == "orphan_result"
    assert (got[2, "a"]["n_calls"], got[2, "a"]["n_results"], got[2, "a"]["status"]) == (2, 2, "ok")
    for x in got.values():
        whole = json.loads(x["json"])
        assert json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == x["json"]
    assert json.loads(got[1, "a"]["json"]) == {"arguments": {"n": 3, "q": "x"}, "id": "a", "name": "find", "result": 'said "x"\n'}
    assert json.loads(got[1, "b"]["json"])["result"] is None


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", None), (2, 1, "assistant", "x"), (None, 0, "user", "x"), (3, None, "user", "x"), (1, 0, "user", "hi")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS json", "2 AS name")
    calls, results = chat.conversation_calls(m)
    assert calls.count() == 3 and results.count() == 2
    calls, results = chat.conversation_calls(m.limit(0))
    schemas = spark.sql("SELECT 'reply' AS name, 'text' AS param, 'string' AS type, true AS required")
    assert chat.link_tool_calls(calls, results, schemas).count() == 0


def test_long_chains_and_cycles(spark):
    n = 300
    calls = [(1, f"c{i}", 1, "stop", {}, [f"c{i - 1}"] if i else []) for i in range(n)]
    calls += [(1, "side", 1, "stop", {}, ["c7", "c250", "c100"])]
    calls += [(2, f"r{i}", 1, "stop", {}, [f"r{(i + 1) % 7}"]) for i in range(7)]  # a cycle
    calls += [(2, "after", 1, "stop", {}, ["r3", "free"]), (2, "free", 1, "stop", {}, [])]
    calls += [(3, "gone", 1, "stop", {}, ["nowhere"]), (3, "then", 1, "stop", {}, ["gone"]), (3, "self", 1, "stop", {}, ["self"])]
    got = {(r["conv_id"], r["call_id"]): (r["level"], r["status"]) for r in link(spark, calls, []).values()}
    assert [got[1, f"c{i}"] for i in range(n)] == [(i, "unanswered") for i in range(n)]
    assert got[1, "side"] == (251, "unanswered") and got[2, "free"] == (0, "unanswered")
    bad = [(2, f"r{i}") for i in range(7)] + [(2, "after"), (3, "gone"), (3, "then"), (3, "self")]
    assert all(got[x] == (-1, "bad_dependency") for x in bad)


def test_levels_of_random_graphs(spark):
    rng, calls, want = random.Random(3), [], {}
    for c in range(12):
        for i in range(25):
            needs = rng.sample(range(i), min(i, rng.choice((0, 1, 1, 2, 3))))
            want[c, f"x{i}"] = max((want[c, f"x{j}"] + 1 for j in needs), default=0)
            calls.append((c, f"x{i}", 1, "stop", {}, [f"x{j}" for j in needs]))
    got = chat.levels(spark.createDataFrame(calls, CALLS)).collect()
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got} == want and len(got) == len(calls)


def plain_links(calls, results, schemas):
    """Brute force, with Python's JSON."""
    tools = {}
    for name, param, kind, required in schemas:
        tools.setdefault(name, {})[param] = (kind, required)

    def parsed(value):
        try:
            return json.loads("null" if value is None else value, parse_constant=lambda c: 1 / 0), True
        except (ValueError, ZeroDivisionError):
            return value, False

    def fits(value, kind):
        v, ok = parsed(value)
        return ok and {
            "string": isinstance(v, str), "boolean": isinstance(v, bool), "object": isinstance(v, dict),
            "array": isinstance(v, list), "null": v is None,
            "integer": isinstance(v, int) and not isinstance(v, bool),
            "number": isinstance(v, (int, float)) and not isinstance(v, bool),
        }[kind]

    def errors(name, args):
        if name not in tools:
            return "unknown tool"
        params = tools[name]
        return ",".join(
            [f"missing {p}" for p in sorted(params) if params[p][1] and p not in args]
            + [f"type {p}" for p in sorted(params) if p in args and not fits(args[p], params[p][0])]
            + [f"unknown {p}" for p in sorted(args) if p not in params]
        )

    def dumped(x):
        return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def body(call_id, name, args, content):
        return dumped({"arguments": None if args is None else {k: parsed(v)[0] for k, v in args.items()}, "id": call_id, "name": name, "result": content})

    level = {}
    by_key = {(c[0], c[1]): c for c in calls if c[0] is not None and c[1] is not None}
    waiting = set(by_key)
    bad = {k for k, c in by_key.items() if any((o := by_key.get((k[0], d))) is None or o[2] > c[2] for d in c[5] or [])}
    waiting -= bad
    while True:
        inside = {k: [(k[0], d) for d in by_key[k][5] or [] if by_key[k[0], d][2] == by_key[k][2]] for k in waiting}
        free = [k for k in waiting if all(d in level for d in inside[k])]
        if not free:
            break
        level.update({k: max((level[d] + 1 for d in inside[k]), default=0) for k in free})
        waiting -= set(free)
    answers = {(r[0], r[1]): r for r in results if r[0] is not None and r[1] is not None}
    out = []
    for k in {*by_key, *answers}:
        c, r = by_key.get(k), answers.get(k)
        wrong = errors(c[3], c[4] or {}) if c else ""
        status = "orphan_result" if not c else "bad_dependency" if k not in level else "invalid" if wrong else "ok" if r else "unanswered"
        out.append((*k, c[2] if c else r[2], level.get(k, -1) if c else 0, status, wrong, body(k[1], c[3] if c else None, (c[4] or {}) if c else None, r[3] if r else None)))
    out += [(c[0], c[1], c[2], 0, "no_id", errors(c[3], c[4] or {}), body(c[1], c[3], c[4] or {}, None)) for c in calls if c[0] is None or c[1] is None]
    out += [(r[0], r[1], r[2], 0, "orphan_result", "", body(r[1], None, None, r[3])) for r in results if r[0] is None or r[1] is None]
    return out


VALUES = [
    None, "null", '"x"', '"x" "y"', '"\\u00e9 \\"q\\" \\\\ \\n"', "3", " 3 ", "-7", "2.5", "true", "false", "{broken}", "[1, 2", "1,2", "", "01", "nope",
    '{"b": 1, "a": {"z": [1, {"y": null, "x": "w"}], "k": true}}', "[ 3 , [ ], { } ]", '{"é": "日本"}', "12345678901234567890",
]


def test_brute_force(spark):
    rng, calls, results = random.Random(11), [], []
    schemas = [(t, p, k, r) for t in ("find", "stop") for p, k, r in (
        ("a", "string", True), ("b", "integer", False), ("c", "number", True), ("d", "boolean", False), ("e", "object", False), ("f", "array", False), ("g", "null", False))]
    for c in range(40):
        for i in range(12):
            args = {p: rng.choice(VALUES) for p in rng.sample("abcdefgh", rng.randint(0, 8))}
            needs = [f"x{rng.randint(0, 13)}" for _ in range(rng.choice((0, 0, 1, 2)))]
            calls.append((c, f"x{i}", rng.randint(0, 3), rng.choice(("find", "stop", "gone", None)), rng.choice((args, args, None)), rng.choice((needs, None, [*needs, None]))))
        results += [(c, f"x{rng.randint(0, 15)}", 9, rng.choice((None, "", 'a "b"'))) for _ in range(3)]
    results = list({(r[0], r[1]): r for r in results}.values())
    calls += [(None, "x", 1, "find", {"a": '"x"'}, None), (None, "x", 1, "find", {"a": '"x"'}, None), (1, None, 1, "stop", None, ["x1"])]
    results += [(None, None, 2, "r"), (2, None, None, None)]
    got = chat.link_tool_calls(
        spark.createDataFrame(calls, CALLS).withColumn("status", F.lit(1)),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").withColumn("name", F.lit(1)),
        spark.createDataFrame(schemas, "name string, param string, type string, required boolean"),
    )
    names = ["conv_id", "call_id", "turn", "level", "status", "errors", "json"]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, plain_links(calls, results, schemas)))


def test_numbers_and_keys(spark):
    rows = [({"v": '{"b": 1.50, "a": 1e2, "c": 1.0, "ä": -0}'}, '{"v":{"a":100.0,"b":1.5,"c":1,"ä":0}}'), ({"z": "1", "a": '{"k": 1, "k": 2}'}, '{"a":"{\\"k\\": 1, \\"k\\": 2}","z":1}'), ({}, "{}"), (None, "{}")]
    df = spark.createDataFrame(rows, "m map<string,string>, want string")
    for r in df.select("want", chat.canonical(F.col("m")).alias("got")).collect():
        assert r["got"] == r["want"] and json.loads(r["got"]) is not None
