"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Everything is DataFrame functions. Java's ``split`` and ``regexp_extract_all`` walk the same
matches, so the pieces between the matches give every match's place.

Bootstrapping. The first words of the fixed patterns' spans are the seed entities. The words around
an entity are lexical patterns: the word before it, the two words before it, and the word before
together with the word after; each for any word in the place and for words with a digit or a mark
inside. A pattern without a word does not exist.

1. Patterns that ``min_seeds`` different seeds stand in are candidates. A pass over all words
   counts how often each candidate occurs; those with seeds in less than ``START`` of their places
   leave, so the graph is at most ``1 / START`` times as large as the seeds are many. Words without
   a digit or mark are many, so patterns of any word are counted in the texts with seeds first: what
   is too common there is so in all, and where nothing remains no pass over all words is needed.
2. A second pass collects the instances of the remaining patterns. Patterns and instances form a
   graph that is scored in rounds: a pattern's confidence is the mean score of its instances, by how
   often each occurs (with one doubtful one added), an instance's score is that of its best pattern,
   and seeds keep 1.
3. Patterns with confidence ``min_confidence`` after ``ROUNDS`` rounds mark the words they hold, by
   place, as spans of the kind ``context`` unless a fixed pattern's span is there.

The fixed patterns are written with possessive quantifiers and with look-behinds that let a search
begin only where a run of characters begins (or where the last match ended). They match the same
spans as the plain forms, in linear time and without deep recursion on long runs.

A window runs over the spans of one document, never over more. Patterns and instances meet in
aggregates with partial sums, so a pattern with any share of all instances is no bottleneck.
Seeds that make a pattern a candidate are different entities, so copies of a text are one.

Edge cases. A null text is empty and gives a row without spans. Null and repeated ids are kept:
rows are told apart by a generated number. Words may have any length. Ties do not arise: spans are
in the order of place and kind. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, text_of

KINDS = ["email", "ip", "card", "phone"]
INSTANCE = len(KINDS)

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPACE = r"\x20\x09-\x0D"

ROUNDS, MIN_SEEDS, START, MIN_CONFIDENCE = 3, 5, 0.25, 0.75


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 0, d).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def core(word: Column) -> Column:
    """A word without the marks around it."""
    return F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{N}+]+", ""), r"[^\p{L}\p{N}]+$", "")


def _matches(text: Column, kind: str, gate: Column) -> Column:
    """For each match of a kind its place in the row of matches, lengths, and its surroundings.

    ``value`` is the first word of the entity, ``p1`` and ``p2`` are the words before it and ``nx``
    the one after its first word, as far as they stand between this match and its neighbours.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    both = F.arrays_zip(found, gaps, F.slice(gaps, 2, F.size(found))).cast("array<struct<m:string,g:string,t:string>>")
    n = KINDS.index(kind)

    def made(x: Column, i: Column) -> Column:
        match, gap, tail = x["m"], x["g"], F.lower(x["t"])
        before = F.regexp_replace(F.lower(F.concat(F.when(i == 0, " ").otherwise(""), gap)), f"[{SPACE}]+", " ")
        blanks = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
        last = F.split(F.substring_index(before, " ", -3), " ")  # the last is what stands before it in its own word
        head = lambda k: F.element_at(last, -k)
        bare = ~head(1).rlike(r"[\p{L}\p{N}+]")
        rest = F.regexp_extract(tail, f"^[^{SPACE}]*", 0)
        first = F.regexp_extract(F.lower(match), f"^[^{SPACE}]*", 0)
        whole = F.length(first) == F.length(match)
        after = F.when(whole, F.regexp_extract(tail, f"^[^{SPACE}]*[{SPACE}]+([^{SPACE}]+)", 1)).otherwise(
            F.concat(F.regexp_extract(F.lower(match), f"^[^{SPACE}]*[{SPACE}]+([^{SPACE}]+)", 1),
                     F.when(F.regexp_count(match, F.lit(f"[{SPACE}]+")) == 1, rest).otherwise(""))
        )
        return F.struct(
            F.lit(n).alias("kind"), i.alias("i"), F.length(gap).alias("gap"), F.length(match).alias("len"), holds(kind, match).alias("ok"),
            core(F.when(whole, F.concat(first, rest)).otherwise(first)).alias("value"),
            F.when(bare & (blanks >= 2), head(2)).otherwise("").alias("p1"),
            F.when(bare & (blanks >= 3), head(3)).otherwise("").alias("p2"),
            after.alias("nx"),
        )

    rows = F.transform(F.filter(both, lambda x: x["m"].isNotNull()), made)
    return F.when(gate, rows)


HIT = "struct<kind:int,i:int,gap:int,len:int,ok:boolean,value:string,p1:string,p2:string,nx:string>"


def located(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, hits``: all rows with their matches, a table."""
    text, some = F.col("text"), F.col("text").rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": some, "card": some, "phone": F.contains(text, F.lit("+"))}
    empty = F.array().cast(f"array<{HIT}>")
    return materialize(
        docs.select("doc_id", text_of().alias("text")).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "text",
            F.concat(*[F.coalesce(_matches(text, k, gates[k]), empty) for k in KINDS]).alias("hits"),
        ),
        "pii_hits",
    )


def placed(rows: DataFrame) -> DataFrame:
    """``row, kind, start, end, value, p1, p2, nx`` of the matches that count."""
    order = Window.partitionBy("row", "kind").orderBy("i")
    before = F.sum(F.col("gap") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    whole = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    start = F.coalesce(before, F.lit(0)) + F.col("gap")
    return whole.withColumn("start", start).filter("ok").select(
        "row", "kind", "start", (F.col("start") + F.col("len")).alias("end"), "value", "p1", "p2", "nx"
    )


#: A word with a digit, or with a mark that identifiers have between two letters.
MARKED = r"[0-9]|\p{L}[@._:/+#=~\\]+\p{L}"


def lexical(value: Column, marked: bool) -> Column:
    """The patterns of an entity with the words ``p1``, ``p2``, ``nx`` around it; those for marked
    words alone begin with ``#``."""
    sign = F.lit("#" if marked else "")
    contexts = F.filter(
        F.array(
            F.concat(sign, F.lit("1 "), "p1"),
            F.when(F.col("p2") != "", F.concat(sign, F.lit("2 "), "p2", F.lit(" "), "p1")),
            F.when(F.col("nx") != "", F.concat(sign, F.lit("3 "), "p1", F.lit(" _ "), "nx")),
        ),
        lambda c: c.isNotNull(),
    )
    return F.when(value.rlike(MARKED), contexts) if marked else contexts


def words(rows: DataFrame, patterns: DataFrame, marked: bool) -> DataFrame:
    """``row, at, value, pattern``: the words (or marked words) that stand in one of ``patterns``
    (``pattern, p1``); ``at`` is a word's number in its text."""
    if marked:
        rows = rows.filter(F.lower("text").rlike(MARKED))
    split = rows.select("row", F.split(F.lower("text"), f"[{SPACE}]+", -1).alias("w"))
    at = F.sequence(F.lit(0), F.size("w") - 1)
    if marked:
        at = F.filter(at, lambda i: F.get("w", i).rlike(MARKED))
    near = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    around = F.transform(
        at, lambda i: F.struct(i.alias("at"), near(i).alias("word"), near(i - 1).alias("p1"), near(i - 2).alias("p2"), near(i + 1).alias("nx"))
    )
    spread = split.select("row", F.explode(around).alias("x")).select("row", "x.*").filter("word <> '' AND p1 <> ''")
    spread = spread.join(patterns.select("p1").distinct(), "p1", "left_semi")
    valued = spread.withColumn("value", core(F.col("word"))).filter("value <> ''")
    held = valued.select("row", "at", "value", F.explode(lexical(F.col("value"), marked)).alias("pattern"))
    return held.join(patterns.select("pattern"), "pattern", "left_semi")


def frequent_enough(possible: DataFrame, rows: DataFrame, marked: bool, start: float) -> DataFrame:
    """The patterns of ``possible`` with seeds in a share ``start`` of the places that ``rows`` have."""
    places = words(rows, possible, marked).groupBy("pattern").agg(F.count(F.lit(1)).alias("places"))
    kept = possible.join(places, "pattern").filter(F.col("seeds") >= start * F.col("places")).select(*possible.columns)
    return materialize(kept, "pii_patterns")


def candidates(seeds: DataFrame, min_seeds: int) -> DataFrame:
    """``pattern, p1, seeds`` of patterns that enough different seeds stand in."""
    own = seeds.filter("p1 <> ''")
    both = F.concat(lexical(F.col("value"), False), F.coalesce(lexical(F.col("value"), True), F.array().cast("array<string>")))
    each = own.select("value", "p1", F.explode(both).alias("pattern")).groupBy("pattern", "p1", "value").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("pattern", "p1").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("seeds")).filter(
        F.col("kinds") >= min_seeds
    ).drop("kinds")


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Confident patterns of the graph ``edges`` (``pattern, value, n, seed``: 0 or 1), each edge once."""
    scores = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    for r in range(rounds):
        found = materialize(
            edges.join(scores, "value").groupBy("pattern").agg((F.sum(F.col("score") * F.col("n")) / (F.sum("n") + 1)).alias("confidence")),
            f"patterns_{r}",
        )
        trusted = found.filter(F.col("confidence") >= min_confidence)
        if r + 1 == rounds:
            return trusted.select("pattern")
        best = F.greatest(F.max("seed").cast("double"), F.coalesce(F.max("confidence"), F.lit(0.0)))
        scores = materialize(edges.join(trusted, "pattern", "left").groupBy("value").agg(best.alias("score")), f"scores_{r}")
    raise ValueError("at least one round")


def discovered(
    rows: DataFrame, spans: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, start: float = START,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``row, at``: the words that trusted patterns hold and that are no seeds, ``at`` their number."""
    seeds = spans.select("value", "p1", "p2", "nx").filter("value <> ''")
    possible = materialize(candidates(seeds, min_seeds), "pii_candidates")
    held = None
    for marked in (True, False):
        kept = possible.filter(F.col("pattern").startswith("#") == marked)
        if not marked and not kept.isEmpty():
            kept = frequent_enough(kept, rows.filter(F.exists("hits", lambda h: h["ok"])), marked, start)
        if not kept.isEmpty():
            kept = frequent_enough(kept, rows, marked, start)
            own = words(rows, kept, marked)
            held = own if held is None else held.unionByName(own)
    if held is None:
        return rows.select("row", F.lit(0).alias("at")).limit(0)
    held = materialize(held, "pii_instances")
    known = seeds.select("value").distinct().withColumn("seed", F.lit(1))
    values = held.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"))
    edges = materialize(values.join(known, "value", "left").select("pattern", "value", "n", F.coalesce("seed", F.lit(0)).alias("seed")), "edges")
    trusted = trusted_patterns(edges, rounds, min_confidence)
    unseen = held.join(trusted, "pattern", "left_semi").join(known.select("value"), "value", "left_anti")
    return unseen.select("row", "at").distinct()


def context_spans(rows: DataFrame, spans: DataFrame, found: DataFrame) -> DataFrame:
    """``row, start, end`` of the found words, but for those that a fixed pattern's span meets."""
    held = found.groupBy("row").agg(F.collect_list("at").alias("ats"))
    base = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("base"))
    texts = rows.select("row", "text").join(held, "row").join(base, "row", "left")
    parts, blanks = F.split("text", f"[{SPACE}]+", -1), F.regexp_extract_all("text", F.lit(f"[{SPACE}]+"), F.lit(0))
    length = lambda pieces, n: F.length(F.array_join(F.slice(pieces, 1, n), ""))
    each = texts.select("row", "base", parts.alias("parts"), blanks.alias("blanks"), "ats").select(
        "row", "base",
        F.explode(F.transform("ats", lambda n: F.struct(
            (length(F.col("parts"), n) + length(F.col("blanks"), n)).alias("at"), F.get("parts", n).alias("word")
        ))).alias("x"),
    )
    lead = F.length("x.word") - F.length(F.regexp_replace("x.word", r"^[^\p{L}\p{N}+]+", ""))
    each = each.select("row", "base", (F.col("x.at") + lead).alias("start"), F.length(core(F.col("x.word"))).alias("n"))
    each = each.withColumn("end", F.col("start") + F.col("n"))
    met = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    return each.filter(~F.coalesce(met, F.lit(False))).select("row", "start", "end")


def personal_data(docs: DataFrame, **bounds) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans.

    ``bounds`` are those of ``discovered``.
    """
    rows = located(docs)
    spans = materialize(placed(rows), "pii_spans")
    found = materialize(discovered(rows, spans, **bounds), "pii_found")
    more = context_spans(rows, spans.select("row", "start", "end"), found)
    spans = spans.select("row", "kind", "start", "end").unionByName(
        more.select("row", F.lit(INSTANCE).alias("kind"), "start", "end")
    )
    names = F.array(*[F.lit(k) for k in [*KINDS, "context"]])
    one = F.struct("start", "kind", F.concat_ws(":", names[F.col("kind")], "start", "end").alias("span"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["span"]), ",")
    by_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.array_sort(F.collect_list(one)).alias("all"),
    )
    base = F.coalesce(joined(F.filter("all", lambda x: x["kind"] < INSTANCE)), F.lit(""))
    return rows.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
