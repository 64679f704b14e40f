"""Vector code compression: product codes whose rounds of k-means skip entries by norm-of-sum bounds.

A vector's components become integers, ``floor(1024 * x)``, and it is cut into four equal parts. Each
part position has a codebook of up to 256 entries, which begin as the parts of the smallest ids. Four
rounds assign every part to its nearest entry and move each entry to the floored mean of its parts;
then parts are assigned once more.

Bounds. A row keeps, for each part and each group of ``GROUP`` entries, the distance to the nearest
entry of the group that is not its own, and the round in which that was measured. The codebooks of all
rounds are kept. In a later round an entry can have come nearer by no more than the length of its net
displacement since the bound's own round (the norm of the sum of its moves, which is at most the sum of
their norms). If the bound less the group's largest such length exceeds the distance to the row's own
entry, the group is left out; otherwise its entries are measured again, exactly. Bounds are rounded
down and compared with a margin, distances are exact integers and ties go to the lower index, so codes
are those of a full search.

Spark. Each round is one scan: a task assigns its rows and gives, beside them, one sum and count for
each entry, so at most ``4 * 256`` rows a task are shuffled and as many reach the driver. A round's
table is written in the shared folder, and the table before it is then removed. What is broadcast is
the codebooks of at most five rounds (``5 * 256`` vectors).

Edge cases. Rows whose vector is null or holds null or non-finite components are left out. Null and
repeated ids are rows like others; nulls come after all ids when the first entries are chosen, and of
equal ids the smaller vector first. Vectors must have one length, a multiple of four, and components
so small that squared distances fit in a long (below 2**19 for a length of 64): otherwise it is an
error. Fewer than 256 rows make smaller codebooks; an entry without parts stays. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialize, read, stored_at

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that share a bound.
GROUP = 32


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~odd


def whole_numbers(vectors: list | np.ndarray, dim: int) -> np.ndarray:
    """``floor(SCALE * x)`` as rows of ``dim`` integers; an error if distances could overflow."""
    x = np.asarray(vectors, dtype=np.float64).reshape(-1, dim)
    x = np.floor(x * SCALE)
    if len(x) and np.abs(x).max() > np.sqrt(2.0**62 / max(1, dim)) / 2:
        raise ValueError("components are too large for squared distances in a long")
    return x.astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each row of ``c``; as floats where those are exact."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * float(top) ** 2 < 2.0**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return np.stack([((x - e) ** 2).sum(axis=1) for e in c], axis=1)


def _largest(d: np.ndarray):
    return np.inf if d.dtype == np.float64 else np.iinfo(np.int64).max


class Assigner:
    """Nearest entries of one part position, by the codebooks of all rounds so far."""

    def __init__(self, history: list[np.ndarray]):
        self.last, self.round = history[-1], len(history) - 1
        self.groups = -(-len(self.last) // GROUP)
        net = np.stack([np.sqrt(((self.last - c).astype(np.float64) ** 2).sum(axis=1)) for c in history])
        # by round and group: the largest net displacement since then, a little more for rounding
        self.moved = np.stack([net[:, g * GROUP : (g + 1) * GROUP].max(axis=1) for g in range(self.groups)], axis=1) * (1 + 1e-9)
        self.measured = 0

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, squared distances, bounds and their rounds, of rows not seen before."""
        n = len(x)
        return self.again(x, np.zeros(n, np.int64), np.full((n, self.groups), -np.inf, np.float32), np.zeros((n, self.groups), np.uint8))

    def again(self, x: np.ndarray, code: np.ndarray, low: np.ndarray, stamp: np.ndarray):
        """The same of rows with the codes, bounds and rounds of the round before."""
        was, code, low, stamp = code, code.copy(), low.copy(), stamp.copy()
        best = ((x - self.last[code]) ** 2).sum(axis=1)
        shape = (len(x), self.groups)
        near, second = np.zeros(shape), np.zeros(shape)
        which, seen = np.full(shape, -1), np.zeros(shape, bool)
        reach = low - self.moved[stamp, np.arange(self.groups)[None, :]]

        def measure(rows: np.ndarray, g: int) -> None:
            d = squared(x[rows], self.last[g * GROUP : (g + 1) * GROUP])
            self.measured += d.size
            at, i = d.argmin(axis=1), np.arange(len(rows))
            m = d[i, at]
            d[i, at] = _largest(d)
            near[rows, g], second[rows, g], which[rows, g], seen[rows, g] = m, d.min(axis=1), at + g * GROUP, True
            m = m.astype(np.int64)
            better = (m < best[rows]) | ((m == best[rows]) & (at + g * GROUP < code[rows]))
            best[rows[better]], code[rows[better]] = m[better], (at + g * GROUP)[better]

        for g in range(self.groups):
            rows = np.flatnonzero(~(reach[:, g] > np.sqrt(best) * (1 + 1e-9) + 1e-9))
            if len(rows):
                measure(rows, g)
        # the bound of a group leaves out the row's own entry: one that is no longer its own comes back
        left = (code != was) & ~seen[np.arange(len(x)), was // GROUP]
        for g in np.unique(was[left] // GROUP):
            measure(np.flatnonzero(left & (was // GROUP == g)), g)
        bound = np.sqrt(np.where(which == code[:, None], second, near)) * (1 - 1e-6)
        low[seen], stamp[seen] = bound[seen].astype(np.float32), self.round
        return code, best, low, stamp


def _stacked(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim or (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError(f"vectors must all have {dim} components")
    return flat.reshape(len(column), dim)


def _assigned(batch: pa.RecordBatch, history: list[np.ndarray], assigners: list[Assigner]):
    """Whole-number vectors, codes, errors and packed bounds of a batch's rows."""
    dim, groups, n = history[0].shape[0] * history[0].shape[2], assigners[0].groups, batch.num_rows
    x = _vectors(batch.column("x"), dim)
    x = whole_numbers(x, dim) if len(history) == 1 else x
    codes, error, lows, stamps = [], np.zeros(n, np.int64), [], []
    if len(history) > 1:
        code = _stacked(batch.column("code"), np.uint8, PARTS).astype(np.int64)
        low = _stacked(batch.column("low"), np.float32, PARTS * groups)
        stamp = _stacked(batch.column("stamp"), np.uint8, PARTS * groups)
    for p, own in enumerate(assigners):
        part, at = x.reshape(n, PARTS, -1)[:, p], slice(p * groups, (p + 1) * groups)
        c, d, lo, st = own.first(part) if len(history) == 1 else own.again(part, code[:, p], low[:, at], stamp[:, at])
        codes.append(c)
        lows.append(lo)
        stamps.append(st)
        error += d
    return x, np.stack(codes, axis=1), error, np.concatenate(lows, axis=1), np.concatenate(stamps, axis=1)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _round(rows: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """Rows with their codes and bounds and, with ``entry`` set, the sums of each task's parts."""
    shared = rows.sparkSession.sparkContext.broadcast(history)
    label = dict(rows.dtypes)["label"]
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, label {label}, x array<bigint>, code binary, low binary, stamp binary, part int, entry int, n bigint, total array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        assigners = [Assigner([c[p] for c in history]) for p in range(PARTS)]
        totals, counts, kinds = np.zeros_like(history[0]), np.zeros(history[0].shape[:2], np.int64), None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("vec_id", "label")]
            n = batch.num_rows
            x, code, _, low, stamp = _assigned(batch, history, assigners)
            for p in range(PARTS):
                np.add.at(totals[p], code[:, p], x.reshape(n, PARTS, -1)[:, p])
                counts[p] += np.bincount(code[:, p], minlength=counts.shape[1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1)[: n + 1] if x.shape[1] else np.zeros(n + 1), pa.int32()), pa.array(x.ravel()))
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), lists, _bytes(code.astype(np.uint8)), _bytes(low), _bytes(stamp), *none], names
            )
        if kinds:
            part, entry = np.nonzero(counts)
            n = len(part)
            none = [pa.nulls(n, t) for t in (*kinds, pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())]
            own = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(totals[part, entry].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, *own], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def _moved(sums: DataFrame, last: np.ndarray) -> np.ndarray:
    """The next codebooks: floored means of what was assigned, entries without parts as they were."""
    width = last.shape[2]
    total = F.array(*[F.sum(F.col("total")[i]) for i in range(width)]) if width else F.array().cast("array<bigint>")
    out = last.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total")).collect():
        out[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return out


def compressed(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of each vector that takes part, and the codebooks
    (part, entry, component). ``entries`` is 256 at most, as a code is one byte."""
    spark = vectors.sparkSession
    # a scan of any partition size: each task holds one batch and one sum for each entry
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    dim = len(seeds[0]["x"]) if seeds else PARTS
    if dim % PARTS or any(len(s["x"]) != dim for s in seeds):
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
    first = whole_numbers([s["x"] for s in seeds], dim).reshape(len(seeds), PARTS, dim // PARTS)
    history, before = [first.transpose(1, 0, 2).copy()], None
    if not seeds:
        rounds = 0
    for _ in range(rounds):
        path = fresh_path(spark, "codes")
        table = stored_at(_round(rows, history), path)
        history.append(_moved(table.filter("entry IS NOT NULL"), history[-1]))
        rows = table.filter("entry IS NULL").select("vec_id", "label", "x", "code", "low", "stamp")
        if before:
            discard(spark, before)
        before = path
    shared = spark.sparkContext.broadcast(history)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = shared.value
        assigners = [Assigner([c[p] for c in history]) for p in range(PARTS)] if history[0].shape[1] else []
        for batch in batches:
            _, code, error, *_ = _assigned(batch, history, assigners)
            names = pa.array([r.tobytes().hex() for r in code.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), names, pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    found = materialize(rows.mapInArrow(last, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "vector_codes")
    if before:
        discard(spark, before)
    return found, history[-1]


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, errors, errors summed over equal labels, and the digest of all final entries."""
    found, books = compressed(read(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql(dim: int = 64) -> str:
    """The same by full search, for vectors of ``dim`` components."""
    width = dim // PARTS
    means = ", ".join(f"floor(sum(v[{i + 1}]) / count(*))" for i in range(width))
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT id, p, min(CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) * {ENTRIES} + e) AS m
 FROM parts JOIN book{r} USING (p) GROUP BY id, p)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n, c) AS c FROM book{r} LEFT JOIN (
 SELECT p, m % {ENTRIES} AS e, [{means}] AS n FROM near{r} JOIN parts USING (id, p) GROUP BY ALL) USING (p, e))""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label,
 list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM kept CROSS JOIN (SELECT unnest(range({PARTS})) AS p)),
book0 AS MATERIALIZED (SELECT p, id - 1 AS e, v AS c FROM parts WHERE id <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT id, string_agg(format('{{:02x}}', m % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY id),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (id) CROSS JOIN digest"""


SQL = _sql()
