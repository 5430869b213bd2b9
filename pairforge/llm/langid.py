"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: for every context of up to
``ORDER`` bytes, how often each byte followed it.  A byte that was seen
``n`` times after a context of ``t`` followers, ``d`` of them different, has
probability ``n / (t + d)`` there; with probability ``d / (t + d)`` the model
escapes to the context that is one byte shorter, at last to a uniform choice.
The statistics are frozen, so the code length of a text is the sum of the
lengths of its bytes, and the language with the shortest code wins.

Fitting: bytes are counted on a bounded sample, ``SAMPLE_DOCS`` documents of
each language in expectation, picked by a hash of text and language.
Everything else covers every document and every byte.

Scoring: all code lengths are worked out beforehand into one table a context
length, with one column a language, so a byte costs one hash probe for all
languages together.  The table is broadcast; it holds at most ``MAX_GRAMS``
rows, the most frequent ones of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm import spans as S
from pairforge.llm.inputs import fresh

ORDER = 3
SAMPLE_DOCS = 1000
MAX_GRAMS = 1 << 20
#: Code lengths that are held at once.
CELLS = 1 << 20
UNKNOWN = "und"
LETTER = r"\p{L}"

#: Letters are compared in lower case; runs of other ASCII bytes are told apart only as "no letter".
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _keys(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For n = 1 to ORDER + 1 the last n folded bytes at each place, as one number; texts begin after a space."""
    folded = _FOLD[data].astype(np.uint32)
    before = [folded]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    for back in range(1, ORDER + 1):
        shifted = np.full(len(folded), 0x20, np.uint32)
        shifted[back:] = folded[:-back]
        for step in range(back):
            at = starts + step
            shifted[at[at < len(folded)]] = 0x20
        before.append(shifted)
    keys, key = [folded], folded
    for back in range(1, ORDER + 1):
        key = key | before[back] << np.uint32(8 * back)
        keys.append(key)
    return keys


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all byte grams of (lang, text) batches: lang, size, gram, n."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        data, offsets = S.text_bytes(batch.column(1))
        codes = np.asarray(langs.indices)
        for a, b in S.blocks(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            lang = np.repeat(codes[a:b], np.diff(at)).astype(np.uint64)
            for size, keys in enumerate(_keys(part, at), 1):
                both, n = np.unique(lang << np.uint64(32) | keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array((both >> np.uint64(32)).astype(np.int64))),
                        pa.array(np.full(len(n), size, np.int32)),
                        pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                        pa.array(n),
                    ],
                    ["lang", "size", "gram", "n"],
                )


class _Probe:
    """Rows of sorted keys by an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.append(keys, 0).astype(np.uint32)
        self.slots = np.full(1 << self.bits, len(keys), np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at, self.probes = self._home(keys.astype(np.uint32)), 0
        while len(left):
            self.probes += 1
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = left[free]
            placed = self.slots[at] == left
            left, at = left[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._home(keys)
        row = self.slots[at]
        out = np.where(self.keys[row] == keys, row, -1)
        out[row == len(self.keys) - 1] = -1
        open_ = np.flatnonzero((out < 0) & (row != len(self.keys) - 1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (self._home(keys[open_]) + step) & ((1 << self.bits) - 1)
            row = self.slots[at]
            hit = (row != len(self.keys) - 1) & (self.keys[row] == keys[open_])
            out[open_[hit]] = row[hit]
            open_ = open_[~hit & (row != len(self.keys) - 1)]
        return out


@dataclass
class Model:
    """Frozen code lengths in bits.

    ``rows[k]`` finds a gram of k + 1 bytes, ``bits[k]`` its lengths by
    language.  A gram that no language has seen costs ``escape[k]`` of its
    context, and then the length of the gram without its first byte; after
    ``escape[0]`` all 256 bytes are alike.
    """

    langs: list[str]
    rows: list[_Probe]
    bits: list[np.ndarray]
    contexts: list[_Probe]
    escape: list[np.ndarray]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        keys = _keys(data, offsets)
        count = len(self.langs)
        total = np.zeros((len(offsets) - 1, count))
        row_of = np.repeat(np.arange(len(total)), np.diff(offsets))
        step = max(1, CELLS // count)
        for at in range(0, len(data), step):
            rows, cost = row_of[at : at + step], self._costs([key[at : at + step] for key in keys])
            for i in range(count):
                total[:, i] += np.bincount(rows, cost[:, i], len(total))
        return total

    def _costs(self, keys: list[np.ndarray]) -> np.ndarray:
        """Bits of each byte under each language."""
        cost = np.zeros((len(keys[0]), len(self.langs)), np.float32)
        todo = np.arange(len(cost))
        for k in range(ORDER, -1, -1):
            row = self.rows[k].find(keys[k][todo])
            seen = row >= 0
            cost[todo[seen]] += self.bits[k][row[seen]]
            todo = todo[~seen]
            if not len(todo):
                break
            if k:
                context = self.contexts[k].find(keys[k][todo] >> np.uint32(8))
                known = context >= 0
                cost[todo[known]] += self.escape[k][context[known]]
            else:
                cost[todo] += self.escape[0] + 8.0
        return cost


def _build(langs: list[str], lang: np.ndarray, size: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    count = len(langs)
    rows, bits, contexts, escape = [], [], [None], [None]
    for k in range(ORDER + 1):
        own = size == k + 1
        grams, place = np.unique(gram[own], return_inverse=True)
        seen = np.zeros((len(grams), count))
        seen[place, lang[own]] = n[own]
        if k == 0:
            total, kinds = seen.sum(0), (seen > 0).sum(0)
            whole = np.maximum(total + kinds, 1)
            out = np.log2(whole / np.maximum(kinds, 1))
            with np.errstate(divide="ignore"):
                escape[0] = out.astype(np.float32)
            length = np.where(seen > 0, np.log2(whole / np.maximum(seen, 1)), out + 8.0)
        else:
            context, where = np.unique(grams >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((len(context), count)), np.zeros((len(context), count))
            np.add.at(total, where, seen)
            np.add.at(kinds, where, seen > 0)
            whole = total + kinds
            # A context that the language never saw is skipped free of charge.
            leave = np.where(total > 0, np.log2(np.maximum(whole, 1) / np.maximum(kinds, 1)), 0.0)
            short = rows[k - 1].find(grams & np.uint32((1 << 8 * k) - 1))
            length = np.where(
                seen > 0, np.log2(np.maximum(whole[where], 1) / np.maximum(seen, 1)), leave[where] + bits[k - 1][short]
            )
            contexts.append(_Probe(context))
            escape.append(leave.astype(np.float32))
        rows.append(_Probe(grams))
        bits.append(length.astype(np.float32))
    return Model(langs, rows, bits, contexts, escape)


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Context trees of all languages in ``labelled``; rows without language or text are left out.

    Only counts reach the driver: at most ``MAX_GRAMS`` grams of the bounded sample.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not per_lang:
        return Model([], [], [], [], [])
    share = F.create_map(*[F.lit(x) for k, n in per_lang.items() for x in (k, min(1.0, sample_docs / n))])
    slot = F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(slot < share[F.col("lang")])
    grams = sample.mapInArrow(count_grams, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    # Short grams are few, and every gram's shorter ones must be there: they are kept first.
    top = grams.orderBy("size", F.desc("n"), "gram", "lang").limit(MAX_GRAMS).toArrow()
    langs = sorted(per_lang)
    code = {name: i for i, name in enumerate(langs)}
    return _build(
        langs,
        np.array([code[x] for x in top.column("lang").to_pylist()], np.int64),
        np.asarray(top.column("size")),
        np.asarray(top.column("gram")).astype(np.uint32),
        np.asarray(top.column("n")),
    )


def predict(documents: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its posterior probability (0 to 1) under equal priors.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned.  Ties go to the first language by name.  Existing
    columns of the same names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def best(texts: pa.Array) -> pa.Array:
        model: Model = shared.value
        data, offsets = S.text_bytes(texts)
        if not model.langs or not len(texts):
            pick, sure = np.full(len(texts), -1), np.zeros(len(texts))
        else:
            parts = [model.lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in S.blocks(offsets)]
            bits = np.concatenate(parts)
            pick = bits.argmin(1)
            sure = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, LETTER), False).cast(pa.int8())) > 0
            pick, sure = np.where(letters, pick, -1), np.where(letters, sure, 0.0)
        names = pa.array([*model.langs, UNKNOWN]).take(pa.array(np.where(pick < 0, len(model.langs), pick)))
        return pa.StructArray.from_arrays([names, pa.array(sure)], ["lang", "score"])

    found = fresh(documents, "_found")
    kept = documents.withColumn(found, best(text))
    return kept.withColumns({out: F.col(found).lang, score: F.col(found).score}).drop(found)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict all: adds held_out, lang_pred and score.

    A row without id is not held out.
    """
    flagged = documents.withColumn("held_out", held_out(doc_id))
    model = fit(flagged.filter("NOT held_out"), lang, text)
    return predict(flagged, model, text)
