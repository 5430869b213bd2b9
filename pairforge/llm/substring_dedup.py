"""Substring de-duplication: seed on winnowed anchors, extend, keep long repeats.

A window is ``WINDOW`` consecutive words of one document.  Each window chooses
an anchor, the least of its ``ANCHOR``-word grams, so equal windows choose equal
anchors at equal places.  Consecutive windows with one anchor form a *run*; a
run is the seed with the largest context that its windows can give it.

1. Runs meet by anchor.  A run whose whole context also stands in a document
   with a smaller id is a repeat in full.  Where an anchor has several contexts,
   the first document of each context stays open.
2. Open runs are extended window by window: the hashes of their windows (at
   most ``WINDOW - ANCHOR + 1`` a run) meet, and a window is a repeat when a
   smaller document has it.  All documents of one context have the same windows,
   so nothing is lost by asking only its first one.
3. Neighbouring repeats merge; the words they cover are removed.

Nothing is paired: each row only learns the smallest document of its group.
Equal contexts of one document are combined before anything is shuffled, so an
anchor has at most one row for each document and context.  Shuffled are one row
for each context (about a sixth of the words), the texts once, and the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from pairforge.llm import spans as S
from pairforge.llm.inputs import ids_and_texts
from pairforge.session import stage

WINDOW = 13
ANCHOR = 4

#: A mark holds, from the low end: windows of the run, its first window in the text, bits of the context's hash
#: (with ``context`` 64 bits, beside the 64 of the anchor).
_COUNT_BITS, _START_BITS, _CONTEXT_BITS = 4, 28, 32

#: ``own`` is a hash of the whole text: with it a row keeps its own marks where several share an id.
RUN_SCHEMA = "anchor long, context int, doc_id long, own long, marks array<long>"
MARKS = "array<long>"
ROW = ["doc_id", "own"]


def _windows(words: S.Words) -> tuple[np.ndarray, S.RunHash]:
    """Which words start a full window, and hashes of word runs."""
    n = len(words.starts)
    end_of_row = np.repeat(words.rows[1:], np.diff(words.rows))
    return np.arange(n) + WINDOW <= end_of_row, S.RunHash(words.hashes, S.WORD_BASE)


def seed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each context of (doc_id, text, own) batches, with the marks of all its runs.

    Equal contexts of one text are combined, so text that repeats itself over
    and over makes one row for each of its anchors.
    """
    for batch in batches:
        data, offsets = S.text_bytes(batch.column(1))
        ids, owns = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        for a, b in S.blocks(offsets):
            part = data[offsets[a] : offsets[b]]
            at = offsets[a : b + 1] - offsets[a]
            words = S.find_words(part, at, S.NON_SPACE)
            valid, hashes = _windows(words)
            places = np.arange(max(0, len(words.starts) - ANCHOR + 1))
            grams = hashes.of(places, places + ANCHOR)
            runs = S.winnow(grams, WINDOW - ANCHOR + 1, valid)
            row = np.searchsorted(words.rows, runs.first, "right") - 1
            start = (runs.first - words.rows[row]).astype(np.uint64)
            context = hashes.of(runs.first, runs.first + runs.count + WINDOW - 1)
            more = (context >> np.uint64(32)) & np.uint64((1 << _CONTEXT_BITS) - 1)
            mark = more << np.uint64(_COUNT_BITS + _START_BITS) | start << np.uint64(_COUNT_BITS) | runs.count.astype(np.uint64)
            anchor = grams[runs.anchor]
            order, first = S.combine(row, anchor, context)
            one = order[first[:-1]]
            columns = [anchor[one].view(np.int64), context[one].astype(np.uint32).view(np.int32), ids[a:b][row[one]], owns[a:b][row[one]]]
            marks = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(mark[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), marks], ["anchor", "context", "doc_id", "own", "marks"])


def _unpack(own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and window counts of the marks of a text, within its ``most`` windows."""
    start = ((own >> np.uint64(_COUNT_BITS)) & np.uint64((1 << _START_BITS) - 1)).astype(np.int64)
    count = (own & np.uint64((1 << _COUNT_BITS) - 1)).astype(np.int64)
    keep = start + count <= most
    return start[keep], count[keep]


def _rows(texts: pa.Array, marks: pa.Array):
    """Text by text: its bytes, words, first word and the unpacked marks."""
    data, offsets = S.text_bytes(texts)
    values = np.asarray(marks.flatten()).view(np.uint64)
    ends = np.cumsum(np.asarray(marks.value_lengths().fill_null(0), dtype=np.int64))
    for a, b in S.blocks(offsets):
        part = data[offsets[a] : offsets[b]]
        at = offsets[a : b + 1] - offsets[a]
        words = S.find_words(part, at, S.NON_SPACE)
        for i in range(a, b):
            first, last = words.rows[i - a], words.rows[i - a + 1]
            own = values[ends[i - 1] if i else 0 : ends[i]]
            start, count = _unpack(own, max(0, last - first - WINDOW + 1))
            yield part, words, first, last, start, count


@F.arrow_udf(ArrayType(StructType().add("window", LongType()).add("mark", LongType())))
def open_windows(texts: pa.Array, marks: pa.Array) -> pa.Array:
    """The windows of the marked runs, one by one."""
    hashes, places, sizes, known = [], [], [], (None, None)
    for _, words, first, _, start, count in _rows(texts, marks):
        if known[0] is not words:
            known = words, S.RunHash(words.hashes, S.WORD_BASE)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        window = np.repeat(start, count) + step
        hashes.append(known[1].of(first + window, first + window + WINDOW))
        places.append(window.astype(np.uint64) << np.uint64(_COUNT_BITS) | np.uint64(1))
        sizes.append(len(window))
    empty = [np.zeros(0, np.uint64)]
    fields = [pa.array(np.concatenate(x + empty).view(np.int64)) for x in (hashes, places)]
    return pa.ListArray.from_arrays(
        np.cumsum([0, *sizes], dtype=np.int32), pa.StructArray.from_arrays(fields, ["window", "mark"])
    )


@F.arrow_udf(StructType().add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", StringType()))
def cut_words(texts: pa.Array, marks: pa.Array) -> pa.Array:
    """Word counts, and the words that stay, joined by one space."""
    totals, removed, kept = [], [], []
    for part, words, first, last, start, count in _rows(texts, marks):
        n = int(last - first)
        gone = S.cover(start, start + count + WINDOW - 1, n)
        stay = first + np.flatnonzero(~gone)
        # Each word is taken with the byte before it; the first byte of all is none.
        sizes = words.ends[stay] - words.starts[stay] + 1
        before = np.cumsum(sizes) - sizes
        place = np.repeat(words.starts[stay] - 1 - before, sizes) + np.arange(sizes.sum())
        out = part[np.maximum(place, 0)]
        out[before] = 0x20
        totals.append(n)
        removed.append(int(gone.sum()))
        kept.append(out[1:].tobytes())
    text = pa.array(kept, pa.binary()).cast(pa.string())
    counts = [pa.array(x, pa.int64()) for x in (totals, removed)]
    return pa.StructArray.from_arrays([*counts, text], ["n_words", "n_removed", "kept_text"])


def _by_document(marks: DataFrame) -> DataFrame:
    """All marks of a text in one row; there are fewer than the text has words, as repeated rows have equal ones."""
    return marks.groupBy(*ROW).agg(F.flatten(F.collect_set("marks")).alias("marks"))


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_words, n_removed, kept_text.

    Null and empty texts have no words.  Rows without an id cannot be compared
    and stay whole.  Rows that share an id count as one document: they are no
    repeats of each other, and each is judged by its own text.  Other columns
    are not read, an empty table gives an empty result.
    """
    docs = ids_and_texts(documents, doc_id, text).withColumn("own", F.xxhash64("text"))
    known = docs.filter("doc_id IS NOT NULL")
    runs = known.mapInArrow(seed_runs, RUN_SCHEMA)
    of_anchor = W.partitionBy("anchor")
    whole = F.struct("context", F.shiftrightunsigned(F.get("marks", F.lit(0)), _COUNT_BITS + _START_BITS).bitwiseAND((1 << _CONTEXT_BITS) - 1))
    of_context = W.partitionBy("anchor", "whole").orderBy("doc_id")
    met = stage(
        runs.select("anchor", *ROW, "marks", whole.alias("whole"))
        .select(
            *ROW,
            "marks",
            (F.first("doc_id").over(of_context) < F.col("doc_id")).alias("repeat"),
            (F.min("whole").over(of_anchor) != F.max("whole").over(of_anchor)).alias("several"),
        )
        .filter("repeat OR several")
        .select(*ROW, "marks", "repeat"),
        "repeats",
    )
    still_open = _by_document(met.filter("NOT repeat").select(*ROW, "marks"))
    # The texts are shuffled once for both joins; a name of its own keeps the two sides alike.
    seeds = known.join(still_open, ROW).select(
        F.col("doc_id").alias("owner"), "own", F.explode(open_windows("text", "marks")).alias("w")
    )
    extended = (
        seeds.select("owner", "own", "w.window", "w.mark")
        .withColumn("repeat", F.min("owner").over(W.partitionBy("window")) < F.col("owner"))
        .filter("repeat")
        .select(F.col("owner").alias("doc_id"), "own", F.array("mark").alias("marks"))
    )
    marks = _by_document(met.filter("repeat").select(*ROW, "marks").unionByName(extended))
    judged = known.join(marks, ROW, "left").unionByName(
        docs.filter("doc_id IS NULL").withColumn("marks", F.lit(None).cast(MARKS))
    )
    return judged.select("doc_id", cut_words("text", F.coalesce("marks", F.array().cast(MARKS))).alias("c")).select(
        "doc_id", "c.n_words", "c.n_removed", "c.kept_text"
    )


def kept_digest(kept_text: str = "kept_text") -> Column:
    return F.sha2(F.col(kept_text), 256).alias("kept_sha256")
