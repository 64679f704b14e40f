"""Best-fit packing by patterns: non-negative least squares over the histogram of lengths.

1. Texts become token ids where they lie; longer ones are cut into pieces of the capacity. What
   leaves a task is a row of numbers for each piece.
2. Only the histogram of piece lengths reaches the driver: as many counts as the capacity has
   tokens, whatever the corpus. There, patterns of a few documents that fill a sequence are
   enumerated over coarse length classes, and non-negative least squares finds how often each
   pattern repeats. The counts are rounded down; the last place of a pattern takes the largest
   length that fits. What is left over goes, longest first, to the tightest place that holds it.
3. The plan says for each length which ranks go to which sequences and offsets. Pieces are ranked
   among those of their length in blocks, so a length that a third of all pieces have is no
   bottleneck, and every piece looks its rank up in the plan.

Edge cases. A null or empty text is the end token alone. Ids may be null or repeated: rows are told
apart by a generated number. An empty table gives an empty plan and an empty result. Extra columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, materialize, read, small_batches, text_of

CAPACITY, END_ID = 4096, 1
#: Length classes over the capacity, and documents in a pattern at most. The plan with the fewest
#: sequences is used.
GRIDS = ((64, 4), (128, 3), (512, 2), (32, 3))
#: Bytes of words and their ids that a worker keeps, twice over and besides those of one batch.
CACHED = 64 << 20

#: Printable ASCII and Latin letters whose lower case is one letter, how the tokenizer
#: cuts a lower-case word of these, and how its special tokens begin.
LATIN = re.compile("[!-~À-ÖØ-öø-įıĲ-ſ]+")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
SPECIAL = "<|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts, as the tokenizer file gives them, from a cache of words.

    The tokenizer never joins characters across white space, so a text's ids are those of its
    words. New words take the tokenizer's own steps one by one (normalise, cut into pieces, spell
    bytes, merge). Latin letters take the first steps by table. Words that may hold a special token
    are encoded whole. ``test_packing`` holds all ways against the plain call.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        plain, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {c: cut(plain(chr(c)))[0][0] for c in range(0x80, 0x180) if LATIN.fullmatch(chr(c))}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.cached, self.held = cached, 0
        #: Words met of late, and those met before; a word of the second is moved over when met again.
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return b"".join(self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as the tokenizer cuts and spells it."""
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = b"".join([self.packed[t.id] for t in self.merge(piece)])
        return found

    def _learn(self, words: Iterable[str]) -> None:
        foreign, piece = [], self._piece
        for w in words:
            if w.isascii() and w.isalpha():
                self.young[w] = piece(w.lower())
            elif SPECIAL in w:
                self.young[w] = self._raw(w)
            elif LATIN.fullmatch(w):
                self.young[w] = b"".join([piece(p.translate(self.spelling)) for p in PIECES.findall(w.lower())])
            else:
                foreign.append(w)
        for at in range(0, len(foreign), 1000):
            self._learn_foreign(foreign[at : at + 1000])

    def _learn_foreign(self, words: list[str]) -> None:
        """Words beyond Latin letters, normalised and cut in one call and told apart by their places."""
        # The normaliser turns any white space into blanks, so words that have some go by themselves.
        self.young.update((w, self._raw(w)) for w in words if w.split() != [w])
        words = [w for w in words if w.split() == [w]]
        joined = self.tokenizer.normalizer.normalize_str(" ".join(words))
        plain = joined.split(" ")
        if len(words) != len(plain) or not words:
            self.young.update((w, self._raw(w)) for w in words)
            return
        ends = np.cumsum([len(w) + 1 for w in plain]).tolist()
        ids = [b""] * len(words)
        at = 0
        for spelt, (start, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(joined):
            while start >= ends[at]:
                at += 1
            ids[at] += self._piece(spelt)
        self.young.update(zip(words, ids, strict=True))

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if self.held > self.cached:
            self.young, self.old, self.pieces, self.held = {"": b""}, self.young, {}, 0
        new = set().union(*split).difference(self.young)
        self.held += 300 * len(new) + 8 * sum(map(len, new))
        back = new & self.old.keys()
        self.young.update((w, self.old[w]) for w in back)
        self._learn(new - back)
        known = self.young
        return [b"".join([known[w] for w in ws]) for ws in split]


def _tokenizer(path: str) -> WordTokenizer:
    return held(("tokenizer", path), lambda: WordTokenizer(path))


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32`` (and ``ids``) of each piece."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _tokenizer(path)
        for batch in batches:
            out = []
            for row, doc, data in zip(batch["row"], batch["doc_id"], own.encoded(list(batch["text"])), strict=True):
                data += end
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    out.append((row, doc, n, at // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype("int64"),) if ids else ()))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    return rows.mapInPandas(cut, schema)


def patterns(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of at most ``depth`` classes that add up to ``classes``."""

    def grow(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for first in range(min(left, most), 0, -1):
                for rest in grow(left - first, first, parts - 1):
                    yield (first, *rest)

    return list(grow(classes, classes, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises ||a x - b||, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    used = np.zeros(a.shape[1], bool)
    floor = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        if gain.max() <= floor:
            break
        used[int(gain.argmax())] = True
        while True:
            s = np.zeros_like(x)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (s <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x += step * (s - x)
            gone = used & (x <= floor)
            if not gone.any():
                gone = low
            used &= ~gone
            x[~used] = 0
        x = s
    return x


class _Plan:
    """Groups of equal sequences: what they hold, how many there are, and what room they have."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.capacity = counts, capacity  # counts[length]
        self.lengths = [int(n) for n in np.flatnonzero(counts)]
        self.open: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
        self.rooms: list[int] = []
        self.full: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.lengths[bisect_left(self.lengths, length)]

    def put(self, held: tuple[tuple[int, int], ...], n: int, room: int) -> None:
        if room == 0 or n == 0:
            if n:
                self.full.append((held, n))
            return
        if room not in self.open:
            self.open[room] = []
            insort(self.rooms, room)
        self.open[room].append((held, n))

    def largest(self, most: int, least: int = 1) -> int | None:
        """The largest length left that is at most ``most``."""
        at = bisect_left(self.lengths, most + 1) - 1
        return self.lengths[at] if at >= 0 and self.lengths[at] >= least else None

    def fill(self, pattern: tuple[int, ...], repeats: int, width: int) -> None:
        """Use ``pattern`` up to ``repeats`` times."""
        while repeats > 0:
            held: list[int] = []
            room = self.capacity
            for n, c in enumerate(pattern):
                last = n == len(pattern) - 1
                got = self.largest(room if last else min(c * width, room), 1 if last else (c - 1) * width + 1)
                if got is None:
                    break
                held.append(got)
                room -= got
            if len(held) < len(pattern):
                return
            need = {x: held.count(x) for x in held}
            if any(self.left[x] < k for x, k in need.items()):
                return
            times = min([repeats, *(int(self.left[x]) // k for x, k in need.items())])
            for x, k in need.items():
                self.take(x, k * times)
            self.put(tuple(need.items()), times, room)
            repeats -= times

    def best_fit(self) -> None:
        """Put what is left, longest first, where the least room is left over."""
        for length in reversed(list(self.lengths)):
            n = int(self.left[length])
            self.left[length] = 0
            while n:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    each = self.capacity // length
                    many, rest = divmod(n, each)
                    self.put(((length, each),), many, self.capacity - each * length)
                    if rest:
                        self.put(((length, rest),), 1, self.capacity - rest * length)
                    break
                room = self.rooms[at]
                held, count = self.open[room].pop()
                each = min(room // length, n)
                times = min(count, n // each)
                if count > times:
                    self.open[room].append((held, count - times))
                if not self.open[room]:
                    del self.open[room], self.rooms[at]
                self.put((*held, (length, each)), times, room - each * length)
                n -= each * times
        self.lengths = []

    def groups(self) -> Groups:
        return self.full + [x for room in self.rooms for x in self.open[room]]


Groups = list[tuple[tuple[tuple[int, int], ...], int]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grids: tuple[tuple[int, int], ...] = GRIDS) -> Groups:
    """(((length, how often), ...), sequences): groups of sequences that hold the same lengths."""
    tried = [planned(histogram, capacity, classes, depth) for classes, depth in grids]
    return min(tried, key=lambda groups: sum(n for _, n in groups))


def planned(histogram: dict[int, int], capacity: int, classes: int, depth: int) -> Groups:
    """The plan of one grid of length classes."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    classes = min(classes, capacity)
    width = -(-capacity // classes)
    own = _Plan(counts, capacity)
    if counts[capacity]:
        own.full.append((((capacity, 1),), int(counts[capacity])))
        own.take(capacity, int(counts[capacity]))
    b = np.zeros(classes)
    np.add.at(b, (np.arange(1, capacity + 1) - 1) // width, counts[1:])
    choice = [p for p in patterns(classes, depth) if len(p) > 1]
    if b.any() and choice:
        a = np.zeros((classes, len(choice)))
        for j, p in enumerate(choice):
            for c in p:
                a[c - 1, j] += 1
        # short documents fill any gap later, so a surplus of them costs little
        weight = np.sqrt(np.arange(1, classes + 1) / classes)
        repeats = np.floor(nnls(a * weight[:, None], b * weight) + 1e-6).astype(int)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: choice[j], reverse=True):
            own.fill(choice[j], int(repeats[j]), width)
    own.best_fit()
    return own.groups()


def slots(groups: Groups) -> dict[str, np.ndarray]:
    """For each length its runs of ranks: ``length, rank, sequence, offset``, sorted."""
    rows, rank, base = [], {}, 0
    for held, times in groups:
        offset = 0
        for length, each in held:
            for _ in range(each):
                at = rank.get(length, 0)
                rows.append((length, at, base, offset))
                rank[length] = at + times
                offset += length
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {k: table[:, n] for n, k in enumerate(("length", "rank", "sequence", "offset"))}


def ranked(pieces_: DataFrame) -> DataFrame:
    """Add ``rank``: the place of a piece among those of its length, from 0.

    Pieces are ranked in blocks: as many blocks as each has pieces, so that neither a block of the
    commonest length nor the table of block sizes grows as fast as the input.
    """
    blocks = max(1, isqrt(pieces_.count()))
    block = F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).cast("int")
    dealt = pieces_.withColumn("block", block)
    sizes = materialize(dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "block_sizes")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("row", "piece")) - 1
    return dealt.withColumn("own", own).join(base, ["length", "block"]).withColumn(
        "rank", F.col("base") + F.col("own")
    ).drop("own", "base", "block")


def pack(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``row, piece, length``."""
    histogram = {r["length"]: r["n"] for r in pieces_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(histogram, capacity))
    # One sorted key per run: lengths are at most the capacity, ranks below 2**48.
    keys = (table["length"] << 48) | table["rank"]
    shared = pieces_.sparkSession.sparkContext.broadcast((keys, table["rank"], table["sequence"], table["offset"]))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, ranks, sequences, offsets = shared.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank - ranks[at], "offset": offsets[at]})

    return ranked(pieces_).withColumn("__p", place("length", "rank")).select(
        *[c for c in pieces_.columns], "__p.sequence_id", "__p.offset"
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    return pack(materialize(pieces(docs, tokenizer, capacity, ids), "pieces"), capacity).drop("row")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(read(spark, sf_dir, "documents"))
