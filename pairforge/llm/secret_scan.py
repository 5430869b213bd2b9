"""Secrets in texts: keyword automaton, anchored expressions beside its hits, checksums.

1. One Aho-Corasick automaton over all keywords runs once over the text with
   A-Z lowered.  Runs of hexadecimal digits have no keyword; theirs is 32
   symbols of the digit class, looked for in the text mapped to that class.
2. Only where a keyword begins is the expression of its kind tried, anchored
   there and ending with the text.  A match is used up whether it is accepted
   or not, so the matches are the leftmost non-overlapping ones of a plain scan.
3. Three kinds are rules (``BASE_KINDS``) and accept by length.  The others
   (``CHECKED_KINDS``) are formats that carry a checksum, and accept only if it
   is right: CRC-32 in base 62 (``github``, ``npm``) and the code of BIP 173
   (``nostr``, ``age``).

No shuffle.  Texts are searched whole as UTF-8, in blocks of about 512 KB, one
longer text by itself; offsets are code points.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm.inputs import fresh
from pairforge.llm.spans import LOWER, blocks, text_bytes

BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm", "nostr", "age")
KINDS = BASE_KINDS + CHECKED_KINDS

#: Least characters of an accepted match (``assign``: of its value).
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

#: Fixed values of the formats with a checksum: digits of base 62 and of BIP 173, its generator.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_digits(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six digits of base 62."""
    left, out = zlib.crc32(body), bytearray()
    for _ in range(6):
        left, digit = divmod(left, 62)
        out.append(BASE62[digit])
    return bytes(out[::-1])


def _crc_right(match: re.Match[bytes]) -> bool:
    body = match[0][-36:]
    return crc_digits(body[:30]) == body[30:]


def _bech32_right(match: re.Match[bytes]) -> bool:
    human, _, data = match[0].lower().rpartition(b"1")
    state = 1
    for value in (*(c >> 5 for c in human), 0, *(c & 31 for c in human), *(BECH32.index(c) for c in data)):
        high, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ value
        for bit, term in enumerate(GENERATOR):
            state ^= term * (high >> bit & 1)
    return state == 1


@dataclass(frozen=True)
class Rule:
    """Keywords (in lower case, none holding another), the expression that begins with one, and what it accepts."""

    kind: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    accepts: Callable[[re.Match[bytes]], bool]


RULES = (
    Rule(
        "assign",
        (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"),
        re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
        lambda m: m.end(1) - m.start(1) >= ASSIGN_LEAST,
    ),
    Rule("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= ACCESS_LEAST),
    Rule("github", tuple(b"gh%c_" % c for c in b"pousr"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}"), _crc_right),
    Rule("npm", (b"npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}"), _crc_right),
    Rule("nostr", (b"nsec1",), re.compile(rb"nsec1[ac-hj-np-z02-9]{58}"), _bech32_right),
    Rule("age", (b"age-secret-key-1",), re.compile(rb"AGE-SECRET-KEY-1[AC-HJ-NP-Z02-9]{58}"), _bech32_right),
)
HEX_RUN = re.compile(rb"[0-9a-f]+")
HEX_CLASS = bytes.maketrans(b"0123456789abcdef", b"0" * 16)
LOWER_TABLE = LOWER.tobytes()


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for number, rule in enumerate(RULES):
        for word in rule.keywords:
            found.add_word(word.decode("latin-1"), (number, len(word)))
    found.make_automaton()
    return found


def _scan(data: bytes, offsets: np.ndarray, automaton: ahocorasick.Automaton) -> tuple[list[int], list[int], list[int], list[int]]:
    """Row, kind, start and end (bytes of ``data``) of every accepted match of texts that lie side by side."""
    rows, kinds, starts, ends = [], [], [], []

    def keep(row: int, kind: str, start: int, end: int) -> None:
        rows.append(row)
        kinds.append(KINDS.index(kind))
        starts.append(start)
        ends.append(end)

    hits = [(end + 1 - size, number) for end, (number, size) in automaton.iter(data.translate(LOWER_TABLE).decode("latin-1"))]
    row_of = np.searchsorted(offsets, [at for at, _ in hits], "right") - 1
    # A hit over the end of a text fails, as the expression may not look beyond it.
    used = [0] * len(RULES)
    for (at, number), row in zip(hits, row_of.tolist()):
        rule = RULES[number]
        if at >= used[number] and (match := rule.pattern.match(data, at, int(offsets[row + 1]))):
            used[number] = match.end()
            if rule.accepts(match):
                keep(row, rule.kind, at, match.end())

    classes, at = data.translate(HEX_CLASS), 0
    while (at := classes.find(b"0" * HEX_LEAST, at)) >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        end = HEX_RUN.match(data, at, int(offsets[row + 1])).end()
        if end - at >= HEX_LEAST:
            keep(row, "hex", at, end)
        at = end
    return rows, kinds, starts, ends


def _code_points(text: bytes, places: np.ndarray) -> np.ndarray:
    """Code points before each byte place."""
    if text.isascii():
        return places
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])[places]


def _spans_of(texts: pa.Array) -> pa.Array:
    raw, offsets = text_bytes(texts)
    counts = np.zeros(len(texts), np.int64)
    all_kinds, all_starts, all_ends = [], [], []
    automaton = _automaton()
    for first, last in blocks(offsets):
        data, local = raw[offsets[first] : offsets[last]].tobytes(), offsets[first : last + 1] - offsets[first]
        row, kind, start, end = (np.asarray(x, np.int64) for x in _scan(data, local, automaton))
        order = np.lexsort((end, kind, start))
        row, kind, start, end = row[order], kind[order], start[order], end[order]
        counts[first:last] = np.bincount(row, minlength=last - first)
        # In order of the starts, the matches of one text stand together.
        edges = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            begin, stop = int(local[row[a]]), int(local[row[a] + 1])
            text = data[begin:stop]
            start[a:b], end[a:b] = _code_points(text, start[a:b] - begin), _code_points(text, end[a:b] - begin)
        all_kinds.append(kind)
        all_starts.append(start)
        all_ends.append(end)
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    names = pa.array(KINDS).take(pa.array(join(all_kinds)))
    places = [pa.array(join(p).astype(np.int32)) for p in (all_starts, all_ends)]
    values = pa.StructArray.from_arrays([names, *places], ["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def find_secrets(documents: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: array of (kind, start, end) of every secret, by start, then kind as in ``KINDS``, then end.

    Offsets are code points, the end exclusive.  Matches of one kind never
    overlap, those of different kinds may.  Null and empty texts have none;
    repeated rows, null ids and an empty table need no special care, as each row
    is judged by its own text.  Other columns are kept, one named ``out`` is
    replaced.
    """
    return documents.withColumn(out, F.arrow_udf(_spans_of, "array<struct<kind: string, start: int, end: int>>")(text))


def mask(documents: DataFrame, text: str = "text") -> DataFrame:
    """Replace every secret by its kind in angle brackets; overlapping ones become one, named after the first.

    Null texts stay null, all columns are kept.
    """
    spans = fresh(documents, "_secrets")
    hidden = F.arrow_udf(_masked, "string")
    return find_secrets(documents, text, spans).withColumn(text, hidden(F.col(text), F.col(spans))).drop(spans)


def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for value, found in zip(texts, spans):
        whole, at = value.as_py(), 0
        if found.is_valid and len(found):
            parts = []
            for span in found.as_py():
                if span["start"] >= at:
                    parts += [whole[at : span["start"]], f"<{span['kind']}>"]
                at = max(at, span["end"])
            whole = "".join([*parts, whole[at:]])
        out.append(whole)
    return pa.array(out, pa.string())


def _digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digests(found: str = "secrets") -> list[Column]:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    of = lambda *kinds: F.filter(found, lambda s: s.kind.isin(*kinds))
    return [
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(_digest_text(of(*BASE_KINDS)), 256).alias("base_sha256"),
        _digest_text(F.col(found)).alias("spans"),
    ]
