"""Byte-pair encoding by backtracking, and decoding by an offset table.

A word is encoded from left to right.  One pass of an Aho-Corasick automaton
over the word finds, for each place, the longest token that starts there.  The
encoder tries that token; a token may stand next to its left neighbour only if
the two are *compatible*, that is if the merge rules would never have joined
symbols across their border.  If not, the next shorter token that is a prefix
of it is tried, and if there is none the last token is taken back.  A place
from which no way leads on is closed, so each place is left at most once and
the work is linear in the word.  A chain in which all neighbours are
compatible is exactly what the merge rules give.

The vocabulary file holds a normaliser (NFC, white space, lower case), a
splitter and merges with an end-of-word mark, and decodes to its token texts
joined by one space.  Strings of special tokens in a text are those tokens.

Distinct words are few beside words, so each task keeps what it has encoded in
a table of at most ``CACHE_BYTES``.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType
from tokenizers import Regex, normalizers, pre_tokenizers

from pairforge.llm.inputs import fresh

#: Bytes of the words, with their ids, that a task remembers (about 130 more for each as an entry), and pairs of
#: tokens; a table is emptied when it is full.
CACHE_BYTES, ENTRY, CACHE_PAIRS = 36 << 20, 180, 150_000
#: Bits of a token number in the number of a pair.
PAIR_BITS, NONE = 26, -1
#: Ids that are decoded at once.
DECODE_BLOCK = 1 << 16
#: Rows of a batch that are worked on at once, which bounds what a task holds beside its results.
ROWS = 256
NEVER = 1 << 60
#: A character outside these blocks may be newer than the Unicode tables of one library and not of the other;
#: such texts are split by the tokenizer library's own normaliser and splitter.
UNSETTLED = regex.compile("[^\x00-\u052f\u0590-\u0870\u0900-\u0bff\u2000-\u2060\u20a0-\ua7c0\uac00-\ud7a3]")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one vocabulary file.

    A symbol is a byte or a byte at the end of a word; inside, it is the
    character of that code or of 256 more.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], _byte_letters()
        ids, mark = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        )
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.normalizer = normalizers.Sequence(
            [normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]
        )
        self.splitter = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        symbols: dict[str, str] = {}
        for byte, letter in letters.items():
            symbols[letter], symbols[letter + mark] = chr(byte), chr(256 + byte)
        # Tables by token number; NONE where there is nothing.
        self.left, self.right, self.born, self.length, self.shorter = ([NONE] * (max(ids.values()) + 1) for _ in range(5))
        #: Rank of the rule for a pair of tokens, under the number of the pair.
        self.joined: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            symbols[a + b] = symbols[a] + symbols[b]
            whole = ids[a + b]
            self.left[whole], self.right[whole], self.born[whole] = ids[a], ids[b], rank
            self.joined[ids[a] << PAIR_BITS | ids[b]] = rank
        by_symbols = {s: ids[t] for t, s in symbols.items() if t in ids}
        self.automaton = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            self.length[i] = len(s)
            self.shorter[i] = next((by_symbols[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_symbols), NONE)
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        texts = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        parts = [(" " + texts.get(i, "")).encode() for i in range(max(texts) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.words = _Words(self)

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` may stand side by side."""
        pair = a << PAIR_BITS | b
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[pair] = self._fits(a, b)
        return known

    def _fits(self, x: int, y: int) -> bool:
        # Go back in time along both sides of the border.  x and y lie at the border until the rule of
        # rank x_ends or y_ends takes them in.  The leftmost of equal rules goes first.
        x_ends = y_ends = NEVER
        while True:
            rank = self.joined.get(x << PAIR_BITS | y)
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if self.born[x] < 0 and self.born[y] < 0:
                return True
            if self.born[x] >= self.born[y]:
                x, x_ends = self.right[x], self.born[x]
            else:
                y, y_ends = self.left[y], self.born[y]

    def encode_symbols(self, word: str) -> list[int]:
        longest: dict[int, int] = {}
        length = self.length
        for end, token in self.automaton.iter(word):
            start = end + 1 - length[token]
            if start not in longest or length[longest[start]] < length[token]:
                longest[start] = token
        closed, tokens, at = set(), [], 0
        token = longest[0]
        while True:
            end = at + length[token]
            if end not in closed and (not tokens or self.fits(tokens[-1], token)):
                tokens.append(token)
                at = end
                if at == len(word):
                    return tokens
                token = longest[at]
                continue
            token = self.shorter[token]
            while token == NONE:
                closed.add(at)
                last = tokens.pop()
                at -= length[last]
                token = self.shorter[last]

    def _normal(self, text: str) -> list[str]:
        if not text.isascii():
            if UNSETTLED.search(text):
                return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes by single characters here, without a final form
                text = text.replace("Σ", "σ")
        return self.pieces.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """The ids of a text as native 32-bit integers."""
        words = self.words
        if self.split_special is None or not any(s in text for s in self.special):
            return b"".join(map(words.__getitem__, self._normal(text)))
        parts = (
            (np.int32(self.special[part]).tobytes(),)
            if part in self.special
            else map(words.__getitem__, self._normal(part))
            for part in self.split_special.split(text)
        )
        return b"".join(chain.from_iterable(parts))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Token texts joined by a space; ``first`` marks the ids that start a row. Also the bytes of each id."""
        starts = self.offsets[ids] + first
        sizes = self.offsets[ids + 1] - starts
        out = []
        for at in range(0, len(ids), DECODE_BLOCK):
            size = sizes[at : at + DECODE_BLOCK]
            before = np.cumsum(size) - size
            out.append(self.blob[np.repeat(starts[at : at + DECODE_BLOCK] - before, size) + np.arange(size.sum())].tobytes())
        return out, sizes


class _Words(dict):
    """Word to packed ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.bytes = vocabulary, 0

    def __missing__(self, word: str) -> bytes:
        if self.bytes >= CACHE_BYTES:
            self.clear()
            self.bytes = 0
        raw = word.encode("utf-8", "surrogatepass")
        symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        packed = np.asarray(self.vocabulary.encode_symbols(symbols), np.int32).tobytes()
        size = len(raw) + len(packed) + ENTRY
        # A word that would take a good part of the table is not worth its place.
        if size < CACHE_BYTES >> 6:
            self[word] = packed
            self.bytes += size
        return packed


@lru_cache(maxsize=2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


class Bpe:
    """Column functions of one vocabulary file, which the driver reads (a few MB) and broadcasts."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            shared: Broadcast[str] = spark.sparkContext.broadcast(file.read())

        def ids_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Number of ids of each text, and all ids."""
            vocabulary = _vocabulary(shared.value)
            packed = [b"" if t is None else vocabulary.encode(t) for t in _values(texts)]
            return np.asarray([len(p) // 4 for p in packed], np.int64), np.frombuffer(b"".join(packed), np.int32)

        def text_of(counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
            """Bytes of each row's text, and all texts."""
            ends = np.cumsum(counts)
            first = np.zeros(len(ids), np.int64)
            first[(ends - counts)[counts > 0]] = 1
            out, sizes = _vocabulary(shared.value).decode(ids, first)
            before = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
            return np.diff(before), out

        # Results of a batch grow in one buffer each, which Arrow then takes as it is.
        def encode(texts: pa.Array) -> pa.Array:
            ids = _Growing()
            for part in _parts(texts):
                counts, found = ids_of(part)
                ids.add(counts, found.tobytes())
            return ids.lists()

        def decode(rows: pa.Array) -> pa.Array:
            text = _Growing()
            for part in _parts(rows):
                counts = np.asarray(part.value_lengths().fill_null(0), np.int64)
                sizes, out = text_of(counts, np.asarray(part.flatten(), np.int64))
                text.add(sizes, *out)
            return text.strings()

        def both(texts: pa.Array) -> pa.Array:
            ids, text = _Growing(), _Growing()
            for part in _parts(texts):
                counts, found = ids_of(part)
                ids.add(counts, found.tobytes())
                sizes, out = text_of(counts, found.astype(np.int64))
                text.add(sizes, *out)
            pa.default_memory_pool().release_unused()
            return pa.StructArray.from_arrays([ids.lists(), text.strings()], ["ids", "decoded"])

        self._encode = F.arrow_udf(encode, ArrayType(IntegerType()))
        self._decode = F.arrow_udf(decode, StringType())
        self._both = F.arrow_udf(both, "ids array<int>, decoded string")

    def ids(self, text: str | Column) -> Column:
        """``array<int>``; null counts as empty text and gives an empty array."""
        return self._encode(text)

    def text(self, ids: str | Column) -> Column:
        """The decoded text; a null or empty array gives an empty text."""
        return self._decode(ids)

    def both(self, text: str | Column) -> Column:
        """A struct of ``ids`` and the text they decode to, from one pass over the data."""
        return self._both(text)


class _Growing:
    """Rows of variable size that are put one after another."""

    def __init__(self):
        self.sizes, self.data = [np.zeros(0, np.int64)], bytearray()

    def add(self, sizes: np.ndarray, *data: bytes) -> None:
        self.sizes.append(sizes)
        for part in data:
            self.data += part

    def _offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype(np.int32)

    def lists(self) -> pa.Array:
        values = pa.Array.from_buffers(pa.int32(), len(self.data) // 4, [None, pa.py_buffer(self.data)])
        return pa.ListArray.from_arrays(pa.array(self._offsets()), values)

    def strings(self) -> pa.Array:
        offsets = self._offsets()
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(self.data))


def _parts(rows: pa.Array):
    return (rows.slice(at, ROWS) for at in range(0, len(rows), ROWS))


def _values(texts: pa.Array):
    """The texts one by one, so that only one of them is a Python string at a time."""
    return (t.as_py() for t in texts)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the ids of ``text`` and the text they decode to; columns of those names are replaced.

    No shuffle; any other column, null texts (as empty), empty texts, repeated
    rows and an empty table are kept as they are.
    """
    both = fresh(df, "_both")
    coded = df.withColumn(both, Bpe(df.sparkSession, path).both(text))
    return coded.withColumns({ids: F.col(both).ids, decoded: F.col(both).decoded}).drop(both)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    """Token count and the two digests of an encoded row."""
    decimal = F.array_join(F.col(ids).cast("array<string>"), " ")
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
