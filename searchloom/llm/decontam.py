"""Benchmark decontamination by latent semantic retrieval.

1. Whole texts become words, written as one 32-bit hash each; those of a batch are hashed together,
   a byte of all of them at a time. Document frequencies of hashed words
   are counted over all of them; partial counts of each task are summed, and as many numbers as
   there are features reach the driver.
2. A randomised SVD of TF-IDF passages gives a latent space. The passages are all words of all
   documents and of the benchmark, each in one passage. Each power iteration is a Spark job that
   sums what its passages add to a matrix of fixed size. Its dimensions are scaled to equal spread,
   else the language of a passage would outweigh its content.
3. Every whole text is cut into overlapping passages of three lengths. A passage's latent vector is
   a sum over its words, so it is built from sums over blocks of words. Benchmark items are its
   query set, in blocks of bounded size; an item much longer than a passage is cut into pieces of
   about a passage's length. Passages with a high cosine to an item or a piece of it are candidates;
   how high is measured for each piece on damaged copies of it in that space.
   So are places where ``SHORT`` words of an item stand in a row (the whole item, if it is
   shorter), so verbatim copies of any length are candidates whatever surrounds them.
   A candidate around which more of the item's words are missing than may be is left out.
4. A candidate counts if the longest common subsequence of the item's words and of the words
   around the passage holds most of the item, and most of its answer (its last sentence).

Words are searched where they lie and nothing but hits leaves a task.

Edge cases. Null and empty texts hit nothing; items without words are not searched for; items of
under ``SHORT`` words must occur in full and are found wherever their words stand in a row. Items
with a null id hit with a null id, items with a null text hit nothing. Repeated items give a hit
each, repeated rows too; of several places of an item in a text the one with the largest share
counts, the first among equals. Texts may have any length. Empty tables give empty results. Extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_rows, materialize, read, small_batches, text_of

#: Hashed words, latent dimensions (and more that are drawn), power iterations.
BITS, RANK, EXTRA, POWERS = 14, 64, 8, 2
#: Items in a block.
ITEMS = 5_000
#: Words of a block; blocks of a passage, blocks between two, and words of an item at most that it
#: is compared with. Items beyond the last passage's words are compared in pieces of about as many.
BLOCK, SHAPES = 8, ((2, 1, 22), (3, 1, 36), (5, 2, 1 << 30))
#: Blocks without words after each text, so that no passage has words of two; words of a round.
GAP, ROUND = max(s[0] for s in SHAPES) - 1, 50_000
COSINE, COMMON, ANSWER, SHORT = 0.55, 0.75, 0.6, 8
#: Damaged copies of an item that its own threshold is measured on, their share that may be missed,
#: and the least threshold.
COPIES, MISSED, LEAST = 64, 0.02, 0.4
#: Words of a passage that the space is fitted on; words that a task multiplies at once; rows of a
#: product's block and of blocks at once; parts of the table in a task at most.
SPAN = BLOCK * SHAPES[-1][0]
FIT_WORDS, SUMMED, ROWS, PARTS = 25_000 * SPAN, 16, 1280, 8
#: Words that are hashed at once, bytes of a word of which each byte is looked at with those of other words.
HASHED, LONG = 1 << 19, 64
#: Cosines that are computed at once, words of candidates' surroundings that are looked up at once.
TILE, LOOKED = 1 << 18, 1 << 18
#: Of numbers of words in a row: a factor, and bits of the table that most others fail.
MIX, SIEVE = np.uint64(0x9E3779B97F4A7C15), 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Kinds of bytes: letters and digits, punctuation, and those whose words Python takes apart.
PLAIN, MARK, OTHER = 0, 1, 2
_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = [MARK if chr(b) in PUNCTUATION else PLAIN for b in range(33, 127)]
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def word_hash(word: str) -> int:
    """32-bit hash of a word in lower case and without punctuation around it; 0 if nothing is left."""
    bare = word.strip(PUNCTUATION)
    if not bare.isalnum():
        bare = _EDGE.sub("", bare)
    return zlib.crc32(bare.lower().encode("utf-8", "surrogatepass")) or 1 if bare else 0


class Words:
    """Hashes of a text's words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        self.known |= {word: word_hash(word) for word in set(words).difference(self.known)}
        out = np.array(list(map(self.known.__getitem__, words)), np.uint32)
        return out[out != 0]


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of runs of at most ``LONG`` bytes: of all of them byte by byte, short ones drop out."""
    order = np.argsort(sizes.astype(np.uint8), kind="stable")
    at, sizes = starts[order], sizes[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for first in np.searchsorted(sizes, np.arange(sizes[-1] if len(sizes) else 0), side="right").tolist():
        own, places = crc[first:], at[first:]
        low = own.astype(np.uint8) ^ data[places]
        own >>= np.uint32(8)
        own ^= _CRC[low]
        places += 1
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def word_hashes(words: pa.StringArray) -> np.ndarray:
    """``word_hash`` of each of some words, which have no upper-case A-Z."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
    places = offsets.astype(np.intp) - offsets[0]
    starts, ends, kind = places[:-1].copy(), places[1:].copy(), _KIND[data]
    # letters À to ÿ are two bytes; × and ÷ between them are none
    lead = np.flatnonzero(data == 0xC3)
    second = data[lead + 1]
    letters = lead[(second != 0x97) & (second != 0xB7)]
    kind[letters] = kind[letters + 1] = PLAIN
    data[lead[(second <= 0x9E) & (second != 0x97)] + 1] += 0x20
    others = np.append(0, np.cumsum(kind == OTHER, dtype=np.int32))[places]
    other = np.flatnonzero((others[1:] > others[:-1]) | (ends - starts > LONG))
    ends[other] = starts[other]
    for edge, before, step in ((starts, 0, 1), (ends, 1, -1)):
        left = np.flatnonzero(ends > starts)
        while len(left):
            left = left[kind[edge[left] - before] == MARK]
            edge[left] += step
            left = left[ends[left] > starts[left]]
    sizes = ends - starts
    out = crcs(data, starts, sizes)
    out[out == 0] = 1
    out[sizes == 0] = 0
    if len(other):
        rest = words.take(pa.array(other)).dictionary_encode()
        out[other] = np.array([word_hash(w) for w in rest.dictionary.to_pylist()], np.uint32)[rest.indices.to_numpy()]
    return out


def packed_words(texts: pa.Array) -> pa.Array:
    """The hashes of each text's words, as ``Words.of`` has them, as bytes. Arrow's white space is Python's."""
    split = pc.utf8_split_whitespace(pc.ascii_lower(texts))
    words, ends = split.flatten().cast(pa.string()), np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
    parts = [word_hashes(words.slice(at, HASHED)) for at in range(0, len(words), HASHED)]
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    kept = np.append(0, np.cumsum(out != 0))[ends] * 4
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(kept), pa.py_buffer(out[out != 0])]).cast(pa.binary())


def hashed(words: np.ndarray) -> np.ndarray:
    """Features of words."""
    return ((words * np.uint32(2654435769)) >> np.uint32(32 - BITS)).astype(np.int64)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32)


def worded(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, words`` of each row: its words' hashes as bytes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], packed_words(batch[2])], ["doc_id", "digest", "words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("digest"), text_of().alias("text"))
    return materialize(rows.mapInArrow(split, "doc_id long, digest long, words binary"), "worded")


def inverse_frequencies(words: DataFrame) -> np.ndarray:
    """log((documents + 1) / (documents with the feature + 1)) + small, of each feature."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            n += len(batch)
            texts = [unpacked(data) for data in batch["words"]]
            of = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(own) for own in texts])
            keys = np.sort(of << np.uint64(BITS) | hashed(np.concatenate([*texts, np.zeros(0, np.uint32)])).astype(np.uint64))
            first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            counts += np.bincount(keys[first].astype(np.int64) & (1 << BITS) - 1, minlength=1 << BITS)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"word": np.append(at, -1), "n": np.append(counts[at], n)})

    parts = words.select("words").mapInPandas(count, "word int, n long")
    found = parts.groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    total = int(found.loc[found["word"] < 0, "n"].sum())
    df = np.zeros(1 << BITS)
    found = found[found["word"] >= 0]
    df[found["word"].to_numpy()] = found["n"].to_numpy()
    return np.log((total + 1) / (df + 1)) + 0.01


def fitted_passages(words: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Texts to fit on, all rows and all items: ``words binary``, each ``SPAN`` of them a passage.
    Repeated rows weigh as often as they occur."""
    items = worded(benchmark.select(F.col("item_id").alias("doc_id"), "text")).select("words")
    return words.select("words").unionByName(items)


def summed(table: np.ndarray, rows: np.ndarray, block: int) -> np.ndarray:
    """Sums of each ``block`` of ``table[rows]``: a product with ones adds a block, some blocks at a time."""
    out = np.empty((len(rows) // block, 1, table.shape[1]), table.dtype)
    ones, many = np.ones((1, block), table.dtype), max(1, ROWS // block)
    held = np.empty((many * block, table.shape[1]), table.dtype)
    for n in range(0, len(out), many):
        some = rows[n * block : (n + many) * block]
        part = np.take(table, some, axis=0, out=held[: len(some)], mode="clip")
        np.matmul(ones, part.reshape(-1, block, table.shape[1]), out=out[n : n + many])
    return out[:, 0]


def row_sums(table: np.ndarray, rows: np.ndarray, counts: np.ndarray, block: int) -> np.ndarray:
    """Sums of ``table[rows]`` over groups of ``counts`` rows; groups are filled up to whole blocks,
    whose sums are added likewise."""
    blocks = -(-counts // block)
    first = np.cumsum(blocks) - blocks
    at = np.full(int(blocks.sum()) * block, len(table), np.intp)
    at[np.arange(len(rows)) + np.repeat(first * block - (np.cumsum(counts) - counts), counts)] = rows
    sums = summed(np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)]), at, block)
    if len(blocks) and blocks.max() > 1:
        return row_sums(sums, np.arange(len(sums)), blocks, block)
    out = np.zeros((len(counts), table.shape[1]), table.dtype)
    out[counts > 0] = sums
    return out


def added(texts: list[np.ndarray], q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """What the passages of some texts add to A^T A q, before it is multiplied by ``idf``; the rows of
    ``q`` are multiplied by it already."""
    f = hashed(np.concatenate(texts)).astype(np.uint32)
    lengths = np.array([len(words) for words in texts])
    passages = -(-lengths // SPAN)
    counts = np.full(int(passages.sum()), SPAN)
    counts[np.cumsum(passages) - 1] = lengths - (passages - 1) * SPAN
    of = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
    keys = np.sort(of << np.uint32(BITS) | f)  # there are fewer than 2^18 passages
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, times = keys[starts], np.diff(np.append(starts, len(keys)))
    weights = times * idf[keys & np.uint32((1 << BITS) - 1)]
    norms = np.bincount(keys >> np.uint32(BITS), weights * weights)
    near = row_sums(q, f, counts, SPAN) / norms[:, None].astype(np.float32)
    order = np.argsort(f.astype(np.uint16), kind="stable")
    return row_sums(near, of[order], np.bincount(f, minlength=1 << BITS), SUMMED)


def in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """Texts in lists of passages for about ``FIT_WORDS`` words, twice that at most; longer texts are
    cut between passages."""
    held, size = [], 0
    for batch in batches:
        for data in batch["words"]:
            own = unpacked(data)
            for at in range(0, len(own), FIT_WORDS):
                held.append(own[at : at + FIT_WORDS])
                size += -(-len(held[-1]) // SPAN) * SPAN
                if size >= FIT_WORDS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def randomised_svd(passages: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix, each over its singular value."""
    rng = np.random.default_rng(11)
    q = rng.standard_normal((1 << BITS, RANK + EXTRA)).astype(np.float32)
    rows_of = 256
    # each task hands on a matrix, so it takes several parts of a large table
    parts = max(passages.sparkSession.sparkContext.defaultParallelism, -(-passages.rdd.getNumPartitions() // PARTS))
    passages = passages.coalesce(parts)

    def through(q: np.ndarray) -> np.ndarray:
        """A^T A q, summed over tasks in slices of rows."""
        shared = passages.sparkSession.sparkContext.broadcast((q, idf))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, idf = shared.value
            out, q = np.zeros(q.shape, np.float64), q * idf[:, None].astype(np.float32)
            for texts in in_chunks(batches):
                out += added(texts, q, idf)
            out *= idf[:, None]
            for at in range(0, len(out), rows_of):
                part = out[at : at + rows_of]
                if part.any():
                    yield pd.DataFrame({"at": [at], "part": [part.ravel()]})

        def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, part in zip(batch["at"], batch["part"], strict=True):
                    held[at] = held[at] + part if at in held else part
            if held:
                yield pd.DataFrame({"at": list(held), "part": list(held.values())})

        schema = "at int, part array<double>"
        out = np.zeros(q.shape)
        # what reaches the driver is the matrix, of fixed size
        found = passages.mapInPandas(add, schema).repartition("at").mapInPandas(total, schema).toPandas()
        for at, part in zip(found["at"], found["part"], strict=True):
            out[at : at + rows_of] = np.reshape(part, (-1, q.shape[1]))
        shared.unpersist()
        return out

    for _ in range(POWERS):
        q = np.linalg.qr(through(q))[0].astype(np.float32)
    b = through(q)
    values, turn = np.linalg.eigh(q.T.astype(np.float64) @ b)
    order = np.argsort(-values)[:RANK]
    spread = np.sqrt(np.maximum(values[order], 1e-6 * max(values.max(), 1e-12)))
    return (q @ turn[:, order] / spread).astype(np.float32)


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Item:
    def __init__(self, item_id: int | None, text: str):
        own = Words()
        self.item_id = item_id
        self.words = own.of(text).tolist()
        sentences = [s for s in re.split(r"[.!?]\s+|\n", text) if len(own.of(s))]
        answer = own.of(sentences[-1]).tolist() if sentences else []
        self.set = frozenset(self.words)
        self.missing = int((1 - COMMON) * len(self.words)) if len(self.words) >= SHORT else 0
        self.answer = answer if len(answer) >= 3 else self.words[-max(3, len(self.words) // 4) :]

    def found(self, words: list[int]) -> tuple[float, float] | None:
        """Shares of the item and of its answer among ``words``, if they suffice."""
        if len(self.set.difference(words)) > self.missing:
            return None  # each of these words would be missing from a common subsequence
        share = common_subsequence(self.words, words) / len(self.words)
        if share < (COMMON if len(self.words) >= SHORT else 1.0):
            return None
        answer = common_subsequence(self.answer, words) / len(self.answer)
        return (share, answer) if answer >= ANSWER else None


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """A number for each ``n`` words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n == 1:
        return (words.astype(np.uint64) + np.uint64(1)) * MIX
    half = n // 2
    first = sequences(words, half)
    out = first[: len(words) - n + 1] * MIX + first[half : half + len(words) - n + 1]
    out ^= out >> np.uint64(29)
    return out * MIX + words[n - 1 :] if n % 2 else out


class Search:
    """Benchmark items against the passages of a text."""

    def __init__(self, items: list[Item], vectors: np.ndarray):
        self.vectors = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])  # of features; the last of none
        self.items: list[list[Item]] = [[] for _ in SHAPES]
        for x in items:
            if x.words:
                self.items[next(n for n, s in enumerate(SHAPES) if len(x.words) <= s[2])].append(x)
        pieces = [[(x, part) for x in own for part in self._pieces(x)] for own in self.items]
        self.items = [[x for x, _ in own] for own in pieces]  # of each piece
        queries = [self._queries([part for _, part in own]) for own in pieces]
        self.floors = [self._floors([p for _, p in own], q, s) for own, q, s in zip(pieces, queries, SHAPES, strict=True)]
        self.queries = [q / floors[:, None] for q, floors in zip(queries, self.floors, strict=True)]
        self.rows = self._rows(items)
        self.bits = self._bits()

    def _pieces(self, item: Item) -> list[np.ndarray]:
        words, length = np.array(item.words, np.uint32), SHAPES[-1][0] * BLOCK
        return np.array_split(words, max(1, round(len(words) / length)))

    def _queries(self, pieces: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(pieces), self.vectors.shape[1]), np.float32)
        for n, words in enumerate(pieces):
            out[n] = self.vectors[hashed(words)].sum(axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def _floors(self, pieces: list[np.ndarray], queries: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
        """The cosine that a passage needs for each piece: ``COSINE``, or less, down to ``LEAST``, where
        damaged copies of the piece would be missed in this space. A copy has as many words replaced
        as an item may miss, and lies in its passage as far off as steps let it."""
        length, reach = shape[0] * BLOCK, shape[1] * BLOCK // 2
        out = np.empty(len(pieces), np.float32)
        for n, words in enumerate(pieces):
            own, rng = hashed(words), np.random.default_rng(len(words))  # as in any other block of items
            copies = rng.integers(0, 1 << BITS, (COPIES, len(own) + 2 * length))
            kept = np.argsort(rng.random((COPIES, len(own))), axis=1) >= int((1 - COMMON) * len(own))
            middle = copies[:, length : length + len(own)]
            middle[kept] = np.broadcast_to(own, kept.shape)[kept]
            first = length + (len(own) - length) // 2 + rng.integers(-reach, reach + 1, COPIES)
            passages = self.vectors[np.take_along_axis(copies, first[:, None] + np.arange(length), axis=1)].sum(axis=1)
            cosines = passages @ queries[n] / np.maximum(np.linalg.norm(passages, axis=1), 1e-12)
            out[n] = np.clip(np.quantile(cosines, MISSED), min(LEAST, COSINE), COSINE)
        return out

    def _rows(self, items: list[Item]) -> list[tuple[int, np.ndarray, dict[int, list[Item]]]]:
        """For each number of words in a row that is looked for: which numbers may be one of them
        by their first bits, and whose they are."""
        found: dict[int, dict[int, list[Item]]] = {}
        for x in items:
            n, own = min(SHORT, len(x.words)), np.array(x.words, np.uint32)
            if n:
                # each n-th, and the last: whatever part of a copy is whole has some of them
                keys = sequences(own, n)
                for key in {*keys[::n].tolist(), int(keys[-1])}:
                    found.setdefault(n, {}).setdefault(key, []).append(x)
        out = []
        for n, held in sorted(found.items()):
            some = np.zeros(1 << SIEVE, bool)
            some[np.array(list(held), np.uint64) >> np.uint64(64 - SIEVE)] = True
            out.append((n, some, held))
        return out

    def _bits(self) -> np.ndarray:
        """A bit for each of an item's first 64 different words, in a table by item and word. Items that may
        miss as many are not in it. Entries that meet have the bits of both."""
        words = [[sorted(x.set)[:64] for x in own] for own in self.items]
        self.sought = [np.array([len(w) for w in own]) for own in words]
        self.spared = [np.array([x.missing for x in own]) for own in self.items]
        self.salts = [np.array([zlib.crc32(repr(x.words).encode()) for x in own], np.uint32) for own in self.items]
        size = 8 * sum(int(n.sum()) for n in self.sought)
        self.shift = np.uint32(32 - max(10, size.bit_length()))
        out = np.zeros(1 << 32 - int(self.shift), np.uint64)
        for own, salts in zip(words, self.salts, strict=True):
            for w, salt in zip(own, salts, strict=True):
                np.bitwise_or.at(out, self._places(np.array(w, np.uint32), salt), np.uint64(1) << np.arange(len(w), dtype=np.uint64))
        return out

    def _places(self, words: np.ndarray, salts: np.ndarray) -> np.ndarray:
        return ((words ^ salts) * np.uint32(2654435769)) >> self.shift

    def _possible(self, words: np.ndarray, n: int, items: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which candidates for the ``n``-th shape's items may be found: the others' surroundings,
        ``words[first:last]``, lack more different words than the item may miss."""
        sought, spared = self.sought[n][items], self.spared[n][items]
        out = spared >= sought
        asked = np.flatnonzero(~out & (last > first))
        ends = np.cumsum((last - first)[asked])
        cuts = np.searchsorted(ends, np.arange(LOOKED, ends[-1], LOOKED)) if len(asked) else []
        for some in np.split(asked, np.unique(cuts)) if len(asked) else []:
            if len(some):
                sizes = (last - first)[some]
                starts = np.cumsum(sizes) - sizes
                at = np.arange(int(sizes.sum())) + np.repeat(first[some] - starts, sizes)
                bits = self.bits[self._places(words[at], np.repeat(self.salts[n][items[some]], sizes))]
                found = np.bitwise_count(np.bitwise_or.reduceat(bits, starts))
                out[some] = sought[some] - found.astype(np.int64) <= spared[some]
        return out

    def verbatim(self, texts: list[np.ndarray]) -> Iterator[tuple[int, Item, int, int, float]]:
        """Candidates where words of an item stand in a row."""
        if not texts:
            return
        words = np.concatenate(texts)
        starts = np.concatenate(([0], np.cumsum([len(w) for w in texts])))
        for n, some, held in self.rows:
            keys = sequences(words, n)
            at = np.flatnonzero(some[keys >> np.uint64(64 - SIEVE)])
            for i, key in zip(at.tolist(), keys[at].tolist(), strict=True):
                if key in held:
                    text = int(np.searchsorted(starts, i, side="right")) - 1
                    first = i - int(starts[text])
                    if first + n <= len(texts[text]):
                        for item in held[key]:
                            yield text, item, first, first + n, 1.0

    def _laid_out(self, texts: list[np.ndarray], starts: np.ndarray, n: int) -> np.ndarray:
        """The words of all texts in ``n`` blocks, 0 where there is none; ``starts`` are the texts' first blocks."""
        out = np.zeros(n * BLOCK, np.uint32)
        for start, words in zip((starts * BLOCK).tolist(), texts, strict=True):
            out[start : start + len(words)] = words
        return out

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, Item, int, int, float]]:
        """(text, item, first word, last word, cosine) of passages at or above the threshold that have
        enough of the item's words around them."""
        lengths = np.array([len(w) for w in texts])
        blocks = -(-lengths // BLOCK) + GAP
        starts = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        n = int(blocks.sum())
        words = self._laid_out(texts, starts, n)
        sums = summed(self.vectors, np.where(words == 0, len(self.vectors) - 1, hashed(words)), BLOCK)
        for shape, ((size, step, _), items, queries, floors) in enumerate(zip(SHAPES, self.items, self.queries, self.floors, strict=True)):
            if not items:
                continue
            reaches = np.array([len(x.words) for x in items]) + BLOCK
            own = np.arange(0, n - size + 1, step)
            passages = sums[0 : n - size + 1 : step].copy()
            for i in range(1, size):
                passages += sums[i : n - size + 1 + i : step]
            norm = np.sqrt(np.einsum("ij,ij->i", passages, passages))
            floor = np.maximum(norm, 1e-12)  # queries are over their own
            many = max(1, TILE // len(queries))
            for part in range(0, len(own), many):
                near = passages[part : part + many] @ queries.T
                over = np.flatnonzero(near >= floor[part : part + many, None])
                rows, cols = np.divmod(over, len(queries))
                w = own[part + rows]
                text = np.searchsorted(starts, w + size - 1, side="right") - 1
                a = (w - starts[text]) * BLOCK
                b = np.minimum(a + size * BLOCK, lengths[text])
                a = np.maximum(a, 0)
                lo, hi = np.maximum(b - reaches[cols], 0), np.minimum(a + reaches[cols], lengths[text])
                at = starts[text] * BLOCK
                may = np.flatnonzero(self._possible(words, shape, cols, at + lo, at + hi))
                rows, cols, text = rows[may], cols[may], text[may]
                cosines = near.ravel()[over[may]] * floors[cols] / floor[part + rows]
                for k, item, first, last, cosine in zip(text.tolist(), cols.tolist(), a[may].tolist(), b[may].tolist(), cosines.tolist(), strict=True):
                    yield k, items[item], first, last, cosine

    def _round(self, texts: list[np.ndarray]) -> list[list[tuple[int | None, float, float, float]]]:
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for candidates in (self.candidates, self.verbatim):
            seen: dict[tuple[int, int], int] = {}
            for k, item, a, b, cosine in candidates(texts):
                # regions of neighbouring passages overlap; one that lies in the last is not read again
                reach = len(item.words) + BLOCK
                words, held, key = texts[k], best[k], id(item)
                lo, hi = max(0, b - reach), min(len(words), a + reach)
                if hi <= seen.get((k, key), 0) or (key in held and held[key][2] == 1.0):
                    continue
                seen[k, key] = hi
                shares = item.found(words[lo:hi].tolist())
                if shares and (key not in held or shares > held[key][2:]):
                    held[key] = (item.item_id, cosine, *shares)
        return [list(held.values()) for held in best]

    def hits(self, texts: list[np.ndarray]) -> list[list[tuple[int | None, float, float, float]]]:
        """(item id, cosine, share of the item, share of its answer), the best of each item, for
        each text. Texts go in rounds, so that a call of numpy has many words."""
        out, held, size = [], [], 0
        for words in texts:
            held.append(words)
            size += len(words)
            if size >= ROUND:
                out += self._round(held)
                held, size = [], 0
        return out + (self._round(held) if held else [])


def searches(words: DataFrame, benchmark: DataFrame) -> Iterator[Search]:
    """One search for each block of benchmark items."""
    idf = inverse_frequencies(words)
    vectors = randomised_svd(fitted_passages(words, benchmark), idf) * idf[:, None].astype(np.float32)
    blocks = max(1, -(-benchmark.count() // ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for n in range(blocks):
        rows = benchmark.filter(block == n).select("item_id", text_of().alias("text")).orderBy("item_id", "text").collect()
        yield Search([Item(r["item_id"], r["text"]) for r in rows], vectors)


HITS = "doc_id long, digest long, item_id long, cosine double, common double, answer double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it holds: ``doc_id, digest`` (of the text), ``item_id,
    cosine, common, answer`` (shares of the item and of its answer)."""
    out, words = None, worded(docs)
    names = [c.split()[0] for c in HITS.split(", ")]
    for search in searches(words, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = batch["doc_id"].astype("Int64")
                found = shared.value.hits([unpacked(data) for data in batch["words"]])
                rows = [
                    (doc, digest, *hit)
                    for doc, digest, hits in zip(ids, batch["digest"], found, strict=True)
                    for hit in hits
                ]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "digest": "int64", "item_id": "Int64"})

        found = materialize(words.mapInPandas(find, HITS), "item_hits")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns they had."""
    hits = materialize(contaminated(docs, benchmark).select("doc_id", "digest").distinct(), "hits")
    return drop_rows(docs, hits, {"doc_id": docs["doc_id"], "digest": F.xxhash64(text_of())})


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("digest")
