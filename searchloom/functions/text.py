"""Text expressions. Every function takes and returns columns; none runs Python on rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profiles

# Patterns of personal data in queries (mail, phone, resident number).
PII_PATTERNS = [
    r"[\w.+-]+@[\w-]+\.[\w.]+",
    r"0\d{1,2}[ -]?\d{3,4}[ -]?\d{4}",
    r"\d{6}[ -]\d{7}",
]

# Namespaces of name-based UUIDs (RFC 4122).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"


def bigrams(text: Column) -> Column:
    """Character bigrams of each run of letters and digits; a run of one character stays whole."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z가-힣]+"), F.lit(0))
    of_run = lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    )
    return F.flatten(F.transform(runs, of_run))


def has_pii(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in PII_PATTERNS])


def normal_query(query: Column) -> Column:
    """Lower case, white space collapsed: the key under which queries are equal."""
    return F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_line(line: Column) -> Column:
    """A generated line without a list mark before it and quotes around it."""
    bare = stripped(line)
    mark = F.coalesce(F.length(F.regexp_extract(bare, "^([0-9]+[).]|[•*-])", 0)), F.lit(0))
    bare = stripped(F.substring(bare, mark + 1, F.length(bare)))
    for quote in ('"', "'"):
        bare = F.regexp_replace(bare, f"^{quote}+|{quote}+$", "")
    return stripped(bare)


def tidy(text: Column) -> Column:
    """Lines stripped, empty ones dropped."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment; the query string stays."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def uuid5(key: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based UUID of ``key``."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def document_key(url: Column, doc_id: Column, title: Column, content: Column) -> Column:
    """What a document is known by: its url, else its id, else title and content."""
    some = lambda c: F.when(c != "", c)
    both = F.concat(F.coalesce(title, F.lit("None")), F.lit("\x00"), F.coalesce(content, F.lit("None")))
    return F.coalesce(some(url), some(doc_id), both)


def topic(query_id: Column) -> Column:
    """``q-3-1`` and ``q-3-1-2`` -> ``3``; null for ids of fewer parts or another first one."""
    parts = F.split(query_id, "-")
    return F.when((F.size(parts) >= 3) & (parts[0] == "q"), parts[1])


def slug(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", "model").otherwise(bare)


def shortened(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """The vector over its length."""
    n = norm(vector) + F.lit(1e-12)
    return F.transform(vector, lambda x: x.cast("double") / n)


def truncated(vector: Column, dim: Column | int) -> Column:
    """The first ``dim`` dimensions at unit length."""
    return unit(F.slice(vector, 1, dim))


def dimension_ladder(requested: Column, dim: Column, least: int = 64) -> Column:
    """Dimensions to keep, descending: those requested that the model has, else ``dim`` and its
    halves down to ``least``."""
    usable = F.sort_array(F.array_distinct(F.filter(requested, lambda d: (d > 0) & (d <= dim))), asc=False)
    halves = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.floor(dim / F.pow(F.lit(2.0), i)).cast("int"))
    halves = F.filter(halves, lambda d: d >= least)
    return F.when(F.coalesce(F.size(usable), F.lit(0)) > 0, usable).otherwise(halves)


def resolved_profiles(models: DataFrame) -> DataFrame:
    """Add ``profile`` and ``guessed`` to rows of ``model, override, recorded, base_model``.

    An override wins, then what was recorded, then what the base model's name implies, then what
    the model's own name implies, then the default, which is marked as a guess. An unknown
    override is an error.
    """
    known = F.array(*[F.lit(p) for p in profiles.PROFILES])
    checked = F.when(F.col("override") == "", None).when(
        F.array_contains(known, F.col("override")), F.col("override")
    ).when(
        F.col("override").isNotNull(), F.raise_error(F.concat(F.lit("unknown profile: "), F.col("override")))
    )

    def implied(name: Column) -> Column:
        return reduce(
            lambda a, rule: a.when(F.contains(F.lower(name), F.lit(rule[0])), rule[1]), profiles.NAME_RULES, F
        )

    recorded = F.when(F.array_contains(known, F.col("recorded")), F.col("recorded"))
    found = F.coalesce(checked, recorded, implied(F.col("base_model")), implied(F.col("model")))
    return models.withColumn("profile", F.coalesce(found, F.lit(profiles.DEFAULT))).withColumn("guessed", found.isNull())


def _filled(template: Column, values: dict[str, Column]) -> Column:
    """``template`` with ``{name}`` replaced by values; what a value contains is left alone."""
    parts = F.split(template, r"\{", -1)
    head = F.element_at(parts, 1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def put(part: Column) -> Column:
        name, tail = F.substring_index(part, "}", 1), F.substring(part, F.instr(part, "}") + 1, F.length(part))
        value = reduce(lambda a, kv: a.when(name == kv[0], kv[1]), values.items(), F)
        return F.concat(value, tail)

    return F.concat(head, F.array_join(F.transform(rest, put), ""))


def with_templates(rows: DataFrame) -> DataFrame:
    """Add the templates of each row's ``profile``: a few rows, known in number."""
    return rows.join(F.broadcast(profiles.table(rows.sparkSession)), "profile")


def formatted_query(query: Column, instruction: Column) -> Column:
    return _filled(F.col("query_template"), {"query": query, "instruction": instruction})


def formatted_document(title: Column, content: Column) -> Column:
    template = F.when(title != "", F.col("doc_template")).otherwise(F.col("doc_template_untitled"))
    return _filled(template, {"title": F.coalesce(title, F.lit("")), "content": content})
