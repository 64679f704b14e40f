"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

Novelty. A candidate is an unbroken string of 12 characters or more, at most ``NAMED_WITHIN`` characters
behind a word that names something secret. A raw zstandard dictionary is made of common identifiers and
of the code around the candidate. What the candidate adds to the compressed size, over its own length,
tells how new it is: identifiers, paths, words and repeated values compress well against what surrounds
them; keys do not. A compressor has little to go by in a string of a few dozen bytes, though: a block
costs some bytes however well it compresses, and a word that no dictionary has is as new as a key. So
a candidate, of whatever length, must also have a share of ``STRANGE`` trigrams that occur neither in the
dictionary, nor in common words, nor around it. Trigrams are those of the candidate's words, which end at
separators and capitals; a candidate that hardly has any, being broken up everywhere, is strange. Of
candidates at or above ``NOVELTY`` those that no fixed pattern covers are spans of the kind ``novel``.

Texts are scanned whole, in Arrow batches, where they lie: nothing is shuffled.

Edge cases. A text without spaces and a candidate of any length are one candidate each. A null text is empty and gives a row without spans. Ids may be null or repeated. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches, text_of

KINDS = ["assign", "access", "hex"]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Runs are maximal, so asking for the length in the pattern gives the same matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SENSITIVE = re.compile(
    r"pass(?:word|wd|phrase)|secret|token|api[_-]?key|auth|bearer|credential|private|signature|access[_-]?key", re.I | re.A
)
#: Characters before a candidate that may name it, and around it that prime the compressor.
NAMED_WITHIN, AROUND = 100, 1024
NOVELTY = 0.7
#: Share of unknown trigrams.
STRANGE = 0.7
#: Where words of an identifier end.
BREAK = re.compile(r"[-_/=+.]|(?<=[a-z])(?=[A-Z])")

#: Words that identifiers and paths are made of.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 function return import class public "
    "private static const string number boolean default export require module config settings environment "
    "application service controller repository component interface implementation exception connection "
    "database username password secret token access_key api_key client_id client_secret authorization "
    "bearer credentials certificate signature session request response header content-type https://www. "
    "http://localhost:8080/ /usr/local/bin/ /var/lib/ /home/user/ node_modules/ src/main/java/com/example/ "
    "org.apache.commons. example.com example.org index.html package.json README LICENSE version timestamp "
    "DEFAULT_TIMEOUT_SECONDS MAX_RETRY_COUNT get_current_user set_access_token create_session "
).encode()

#: Common words, for their trigrams.
WORDS = (
    "about above after again against although always another application available because before being "
    "between business called certain change children community company complete condition consider "
    "control country describe development different during education effect english especially "
    "everything example experience following general government however human important include increase "
    "information interest international knowledge language learning management material mechanism "
    "meeting member method national natural necessary never nothing number object operation opportunity "
    "organization particular people performance perhaps person picture political position possible "
    "potential practice present president principle problem process product production program project "
    "property provide public quality question reason relationship representation research resource "
    "responsible result right school science section security several should significant similar simple "
    "situation social something special standard statement strategy structure student subject success "
    "support system technology themselves therefore thing think though thought through together toward "
    "training treatment understand understanding university usually various weather whether which while "
    "within without woman world would write young "
)


def trigrams(text: str) -> list[str]:
    low = text.lower()
    return [low[i : i + 3] for i in range(len(low) - 2)]


KNOWN = frozenset(trigrams(IDENTIFIERS.decode()) + trigrams(WORDS))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's number, ``kind:start:end``), in order."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted((s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in out)


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes of ``candidate`` over its length, given what surrounds it."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(
        IDENTIFIERS + after.encode() + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False).compress
    raw = candidate.encode()
    return (len(compress(raw)) - len(compress(b""))) / max(1, len(raw))


def strange(candidate: str, before: str, after: str) -> float:
    """Share of the trigrams of the candidate's words that are not known and not around it; 1, if there
    are fewer than a third as many as characters."""
    around = KNOWN.union(trigrams(before), trigrams(after))
    own = [t for word in BREAK.split(candidate) for t in trigrams(word)]
    return sum(t not in around for t in own) / len(own) if 3 * len(own) >= len(candidate) else 1.0


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    taken = sorted((s, int(x.rsplit(":", 1)[1])) for s, _, x in base)
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if reach > s or not SENSITIVE.search(text, max(0, s - NAMED_WITHIN), s):
            continue
        word, before, after = m[0], text[max(0, s - AROUND) : s], text[e : e + AROUND]
        if strange(word, before, after) >= STRANGE and novelty(word, before, after) >= NOVELTY:
            out.append((s, len(KINDS), f"novel:{s}:{e}"))
    return out


def scanned(text: str) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    spans = sorted(base + novel_spans(text, base))
    count = [0, 0, 0]
    for _, k, _ in base:
        count[k] += 1
    digest = hashlib.sha256(",".join(x for *_, x in base).encode()).hexdigest()
    return *count, digest, ",".join(x for *_, x in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [scanned(t) for t in batch["text"]]
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
        yield out


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return find_secrets(read(spark, sf_dir, "documents"))
