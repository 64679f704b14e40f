"""Chat formatting: linking tool calls with their results.

Calls and results meet in a hash join on (conversation, call id). Calls are ordered
topologically: a dependency on an earlier turn holds by the order of turns already, so only
dependencies inside a turn are peeled, however deep they go. Arguments are validated against a table of
parameters, and every link is serialised as canonical JSON (keys in order, no white space).

The main path has only DataFrame functions. Nothing is collected for a conversation, so one
conversation may hold any share of the rows: the keys are call ids.

Values are parsed (``try_parse_json``), so types are those of JSON, and objects are canonical at
every depth. Keys are in the order of their UTF-16 code units, numbers keep their digits without
trailing zeros, and numbers with an exponent are written as doubles.

Edge cases. A result without a call, and a call without a result, give a row with the status
``orphan_result`` or ``unanswered``. Of several calls or results with one id the first (by turn,
name, arguments, dependencies; turn, content) counts and ``n_calls``/``n_results`` tell how many
there were. A call without a conversation or an id has a row of its own with the status ``no_id``
and the level 0; such a result is an orphan. A null name is an unknown tool, a null map of arguments
is empty, a null value is JSON's null. A dependency that is null, unknown, on a later turn or in a
cycle gives the level -1 and the status ``bad_dependency``; a call without a turn cannot be ordered,
so any dependency of it is bad, as is one on it. An empty table gives an empty result. Extra columns
are not read. ``conversation_calls`` takes null texts as empty and drops rows without a conversation
or a turn, which have no place in one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_of


def json_text(value: Column) -> Column:
    """A JSON string literal; null stays null."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.regexp_extract(whole, r"(?s)^\{\"v\":(.*)\}$", 1))


def canonical(arguments: Column) -> Column:
    """Canonical JSON of a map from names to JSON values: keys in order at every depth, no white
    space, numbers and strings in their shortest plain form.

    A null map is ``{}`` and a null value is ``null``. Where a value is no JSON (or repeats a key of
    an object), it is written as a string, so that the whole is always JSON.
    """
    pairs = F.transform(
        F.coalesce(F.map_entries(arguments), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.concat(
            json_text(e["key"]), F.lit(":"),
            F.when(F.try_parse_json(e["value"]).isNotNull() & single(e["value"]), e["value"])
            .when(e["value"].isNull(), "null").otherwise(json_text(e["value"])),
        ),
    )
    return F.to_json(F.try_parse_json(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))))


def single(value: Column) -> Column:
    """Whether a text is one JSON value, with nothing after it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1, F.lit(False))


#: The types of parsed JSON values that fit each type of a schema.
TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$",
    "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
    "null": "^VOID$",
}


def json_type(value: Column) -> Column:
    """The type of a JSON value after parsing; null where it is none. A null value is JSON's null."""
    text = F.coalesce(value, F.lit("null"))
    return F.when(single(text), F.schema_of_variant(F.try_parse_json(text)))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``errors``: missing, ill-typed and unknown arguments, in order.

    ``schemas`` has a row (name, param, type, required) for each parameter. It becomes one row
    for each tool; a tool's parameters are few by nature. Values are parsed, not matched by looks;
    a null value is JSON's null and fits the type ``null`` only. A null ``required`` is false, and
    nothing fits a type that is null or unknown.
    """
    tools = schemas.filter("name IS NOT NULL AND param IS NOT NULL").groupBy(F.col("name").alias("__tool")).agg(
        F.array_sort(F.collect_set(F.struct("param", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("__params")
    )
    given = F.coalesce(F.col("arguments"), F.create_map().cast("map<string,string>"))
    fits = lambda p: reduce(
        lambda a, t: a.when(p["type"] == t, F.coalesce(json_type(F.element_at(given, p["param"])).rlike(TYPES[t]), F.lit(False))), TYPES, F
    ).otherwise(F.lit(False))
    missing = F.transform(
        F.filter("__params", lambda p: p["required"] & ~F.map_contains_key(given, p["param"])),
        lambda p: F.concat(F.lit("missing "), p["param"]),
    )
    typed = F.transform(
        F.filter("__params", lambda p: F.map_contains_key(given, p["param"]) & ~fits(p)),
        lambda p: F.concat(F.lit("type "), p["param"]),
    )
    known = F.transform("__params", lambda p: p["param"])
    extra = F.transform(
        F.array_sort(F.array_except(F.map_keys(given), known)), lambda k: F.concat(F.lit("unknown "), k)
    )
    return (
        calls.join(tools, F.col("name") == F.col("__tool"), "left")
        .withColumn(
            "errors",
            F.when(F.col("__tool").isNull(), F.array(F.lit("unknown tool"))).otherwise(
                F.concat(missing, typed, extra)
            ),
        )
        .drop("__tool", "__params")
    )


#: More steps than any turn has calls.
STEPS = 1 << 40


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: the topological level inside a turn, -1 where there is none.

    Ordering by (turn, level, call_id) puts every call after those it depends on. Each round frees
    the calls without open dependencies, and lets a dependency on a call with one open dependency
    reach through to that one, so a chain takes as many rounds as its length has binary digits.
    Rounds end when one frees nothing; what waits then is in a cycle, or depends on one or on a
    call that is bad.
    """
    key = ["conv_id", "call_id"]
    edges = calls.select(*key, "turn", F.explode("depends_on").alias("needs"))
    ends = calls.select(
        F.col("conv_id").alias("__c"), F.col("call_id").alias("__id"), F.col("turn").alias("__t")
    )
    edges = edges.join(ends, (F.col("conv_id") == F.col("__c")) & (F.col("needs") == F.col("__id")), "left")
    bad = edges.filter(~F.coalesce(F.col("__t") <= F.col("turn"), F.lit(False))).select(*key)
    inside = materialize(
        edges.filter(F.col("__t") == F.col("turn")).select(*key, "needs").distinct(), "inside"
    )
    bad = materialize(bad.distinct().withColumn("level", F.lit(-1)), "bad")
    waiting = calls.select(*key).join(bad, key, "left_anti")
    if inside.isEmpty():
        return waiting.withColumn("level", F.lit(0)).unionByName(bad)
    # a call's level is the largest of ``least`` and, over its open dependencies, their level + ``steps``
    waiting = materialize(waiting.withColumn("least", F.lit(0).cast("long")), "waiting")
    later = materialize(inside.join(bad, key, "left_anti").withColumn("steps", F.lit(1).cast("long")), "later")
    out, n = bad, 0
    while True:
        ready = materialize(waiting.join(later, key, "left_anti"), f"ready_{n}")
        if ready.isEmpty():
            return out.unionByName(waiting.select(*key, F.lit(-1).alias("level")))
        out = out.unionByName(ready.select(*key, F.col("least").cast("int").alias("level")))
        gone = ready.select("conv_id", F.col("call_id").alias("needs"), F.col("least").alias("__least"))
        met = later.join(gone, ["conv_id", "needs"]).groupBy(*key).agg(F.max(F.col("__least") + F.col("steps")).alias("__met"))
        left = waiting.join(ready, key, "left_anti").join(met, key, "left")
        waiting = materialize(left.select(*key, F.greatest("least", "__met").alias("least")), f"freed_{n}")
        later = materialize(later.join(gone, ["conv_id", "needs"], "left_anti"), f"open_{n}")
        single = later.groupBy(*key).agg(
            F.count(F.lit(1)).alias("__n"), F.min("needs").alias("__next"), F.min("steps").alias("__more")
        )
        single = single.filter("__n = 1").join(waiting, key).select(
            "conv_id", F.col("call_id").alias("needs"), "__next", "__more", F.col("least").alias("__least")
        )
        # in a cycle the steps would double for ever
        through = materialize(
            later.join(single, ["conv_id", "needs"], "left").select(
                *key,
                F.coalesce("__next", "needs").alias("needs"),
                F.least(F.col("steps") + F.coalesce("__more", F.lit(0)), F.lit(STEPS)).alias("steps"),
                F.when(F.col("__least").isNotNull(), F.least(F.col("steps") + F.col("__least"), F.lit(STEPS))).alias("__met"),
            ),
            f"through_{n}",
        )
        met = through.groupBy(*key).agg(F.max("__met").alias("__met"))
        waiting = materialize(
            waiting.join(met, key, "left").select(*key, F.greatest("least", "__met").alias("least")), f"waiting_{n}"
        )
        later = materialize(through.groupBy(*key, "needs").agg(F.max("steps").alias("steps")), f"later_{n}")
        n += 1


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call id: ``conv_id, call_id, turn, level, status, errors, n_calls, n_results, json``.

    ``calls``: conv_id, call_id, turn, name, arguments map<string,string> of JSON values,
    depends_on array<string>. ``results``: conv_id, call_id, turn, content. A call or result whose
    conv_id or call_id is null cannot be linked and has a row of its own.
    """
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select(*key, "turn", "name", "arguments", F.array_sort("depends_on").alias("depends_on"))
    rank = F.struct("turn", "name", canonical(F.col("arguments")).alias("args"), "depends_on")
    first = calls.filter(named).groupBy(*key).agg(
        F.min(rank).alias("__f"), F.min_by("arguments", rank).alias("arguments"), F.count(F.lit(1)).alias("n_calls")
    )
    first = materialize(first.select(*key, "__f.*", "arguments", "n_calls"), "first_calls")
    answers = results.filter(named).groupBy(*key).agg(
        F.min(F.struct("turn", "content")).alias("__r"), F.count(F.lit(1)).alias("n_results")
    )
    ordered = validated(first, schemas).join(levels(first), key)
    linked = ordered.withColumn("__call", F.lit(True)).join(answers, key, "full_outer")
    lone_calls = validated(calls.filter(~named).withColumn("args", canonical(F.col("arguments"))), schemas).select(
        "*", F.lit(0).alias("level"), F.lit(1).cast("long").alias("n_calls"), F.lit(True).alias("__call")
    )
    lone_results = results.filter(~named).select(
        *key, F.struct("turn", "content").alias("__r"), F.lit(1).cast("long").alias("n_results")
    )
    linked = linked.unionByName(lone_calls, True).unionByName(lone_results, True)
    status = (
        F.when(F.col("__call").isNull(), "orphan_result")
        .when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no_id")
        .when(F.col("level") < 0, "bad_dependency")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("__r").isNull(), "unanswered")
        .otherwise("ok")
    )
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce("args", F.lit("null")),
        F.lit(',"id":'), F.coalesce(json_text(F.col("call_id")), F.lit("null")),
        F.lit(',"name":'), F.coalesce(json_text(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.coalesce(json_text(F.col("__r.content")), F.lit("null")), F.lit("}"),
    )
    return linked.select(
        *key,
        F.coalesce("turn", "__r.turn").alias("turn"),
        F.coalesce("level", F.lit(0)).alias("level"),
        status.alias("status"),
        F.coalesce(F.array_join("errors", ","), F.lit("")).alias("errors"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        body.alias("json"),
    )


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each user turn calls ``reply``; the assistant
    turn right after it is the result; a call depends on the call two turns before, if any.

    Rows with a null ``conv_id`` or ``turn`` have no place in a conversation and are dropped.
    """
    rows = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", "role", text_of().alias("content")
    )
    ident = lambda t: F.concat_ws("-", F.lit("call"), F.col("conv_id"), t)
    asked = rows.filter("role = 'user'")
    before = asked.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("__follows")).distinct()
    calls = asked.join(before, ["conv_id", "turn"], "left").select(
        "conv_id",
        ident(F.col("turn")).alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        F.create_map(
            F.lit("text"), json_text(F.col("content")), F.lit("chars"), F.length("content").cast("string")
        ).alias("arguments"),
        F.when(F.col("__follows"), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = rows.filter("role = 'assistant'").select(
        "conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", "content"
    )
    return calls, results


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(read(spark, sf_dir, "conversations"))
    schemas = spark.sql(
        "SELECT * FROM VALUES ('reply', 'chars', 'integer', true), ('reply', 'text', 'string', true)"
        " AS t(name, param, type, required)"
    )
    return link_tool_calls(calls, results, schemas)


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS content FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
calls AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id,
         '{"chars":' || length(min(content)) || ',"text":' || CAST(to_json(min(content)) AS VARCHAR) || '}' AS args,
         count(*) AS n_calls
  FROM rows WHERE role = 'user' GROUP BY conv_id, turn
),
results AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, min(content) AS content, count(*) AS n_results
  FROM rows WHERE role = 'assistant' GROUP BY conv_id, turn
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
       coalesce(c.turn, r.turn) AS turn, CAST(0 AS INTEGER) AS level,
       CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
       '' AS errors, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       '{"arguments":' || coalesce(args, 'null') || ',"id":' || CAST(to_json(coalesce(c.call_id, r.call_id)) AS VARCHAR)
       || ',"name":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"reply"' END
       || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS json
FROM calls c FULL OUTER JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""
