"""Repeated byte strings: local run-length indexes over anchored segments of the corpus.

Every ``WINDOW`` consecutive bytes of a document choose an anchor, the least of
their ``ANCHOR``-byte grams; equal strings choose equal anchors at equal places.
Consecutive windows with one anchor form a run, whose context are all bytes its
windows cover.  So one index over the corpus falls apart into small ones: equal
strings always meet among the contexts of one anchor.

1. Runs meet by anchor.  A run whose whole context stands in two places is
   repeated in full, in all its places.
2. Where an anchor has several contexts, single ones stay open.  Their bytes,
   with one copy of each repeated context, are dealt out by anchor and go into
   run-length indexes (``run_index``) of about ``INDEX_BYTES``; matching
   statistics of at least ``WINDOW`` mark what another context has as well.
3. Anchors whose open contexts exceed ``INDEX_BYTES`` are split by content that
   equal windows share.  A window holds its anchor and ``WINDOW - ANCHOR`` bytes
   around it, so at least half of these stand on one side: windows with ``SIDE``
   bytes behind the anchor meet by anchor and those bytes, windows with so many
   before it by these.  Contexts that meet no other are done, groups within the
   bound are indexed like anchors; of what is larger still, single windows meet.
4. Marked strings of a document merge; their bytes are removed.

Equal contexts of one document are combined before anything is shuffled, so an
anchor has at most one row for each document and context.  Shuffled are one row
for each context (about one for 50 bytes), the texts once, open contexts and marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from pairforge.llm import spans as S
from pairforge.llm.inputs import ids_and_texts
from pairforge.llm.run_index import longest_matches
from pairforge.session import stage

WINDOW = 200
ANCHOR = 100
INDEX_BYTES = 1 << 19

#: Bytes beside a hot anchor by which its contexts are dealt.
SIDE = (WINDOW - ANCHOR) // 2

#: A mark holds, from the low end: windows of the run, its first byte in the text, the anchor's place in its context.
_COUNT_BITS, _START_BITS, _PLACE_BITS = 8, 40, 8
_PLACE_AT = np.uint64(_COUNT_BITS + _START_BITS)

#: ``own`` is a hash of the whole text: with it a row keeps its own marks where several share an id or have none.
RUN_SCHEMA = "anchor long, context long, doc_id long, own long, marks array<long>"
MARKS = "array<long>"
ROW = ["doc_id", "own"]
OPEN = "anchor long, doc_id long, own long, mark long, single boolean, bytes binary"


def seed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each context of (doc_id, text, own) batches, with the marks of all its runs."""
    for batch in batches:
        data, offsets = S.text_bytes(batch.column(1))
        ids, owns = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        for a, b in S.blocks(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            hashes = S.RunHash(S.BYTE_CODES[part], S.BASE)
            places = np.arange(max(0, len(part) - ANCHOR + 1))
            valid = np.arange(len(part)) + WINDOW <= np.repeat(at[1:], np.diff(at))
            grams = hashes.of(places, places + ANCHOR)
            runs = S.winnow(grams, WINDOW - ANCHOR + 1, valid)
            row = np.searchsorted(at, runs.first, "right") - 1
            start = (runs.first - at[row]).astype(np.uint64)
            place = (runs.anchor - runs.first).astype(np.uint64)
            mark = place << _PLACE_AT | start << np.uint64(_COUNT_BITS) | runs.count.astype(np.uint64)
            context = hashes.of(runs.first, runs.first + runs.count + WINDOW - 1)
            anchor = grams[runs.anchor]
            order, first = S.combine(row, anchor, context)
            one = order[first[:-1]]
            columns = [anchor[one].view(np.int64), context[one].view(np.int64), ids[a:b][row[one]], owns[a:b][row[one]]]
            marks = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(mark[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), marks], ["anchor", "context", "doc_id", "own", "marks"])


def _start_count(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = ((marks >> np.uint64(_COUNT_BITS)) & np.uint64((1 << _START_BITS) - 1)).astype(np.int64)
    return start, (marks & np.uint64((1 << _COUNT_BITS) - 1)).astype(np.int64)


def _rows(texts: pa.Array, marks: np.ndarray, sizes: np.ndarray):
    """Text by text: its bytes, and the starts and window counts of its marks."""
    data, offsets = S.text_bytes(texts)
    ends = np.cumsum(sizes)
    for i in range(len(sizes)):
        start, count = _start_count(marks[ends[i] - sizes[i] : ends[i]])
        fits = start + count + WINDOW - 1 <= offsets[i + 1] - offsets[i]
        yield data[offsets[i] : offsets[i + 1]], start[fits], count[fits]


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)


@F.arrow_udf(ArrayType(BinaryType()))
def contexts(texts: pa.Array, marks: pa.Array) -> pa.Array:
    """The bytes that each marked run covers."""
    out = []
    for data, start, count in _rows(texts, np.asarray(marks.flatten()).view(np.uint64), _lengths(marks)):
        out.append([data[s : s + c + WINDOW - 1].tobytes() for s, c in zip(start.tolist(), count.tolist())])
    return pa.array(out, pa.list_(pa.binary()))


def index_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the windows of single contexts that another context has, from rows sorted by anchor.

    Columns as in ``OPEN``.  Rows of one anchor go into the same index.
    """

    def indexed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        data, starts = S.text_bytes(table.column(5).combine_chunks())
        long = longest_matches(data, starts) >= WINDOW
        marks = np.asarray(table.column(3)).view(np.uint64)
        single = np.asarray(table.column(4).combine_chunks().cast(pa.int8())) > 0
        # A window needs its full length inside the context; runs of hits become marks.
        new = long.copy()
        new[1:] &= ~long[:-1]
        first = starts[:-1][starts[:-1] < len(long)]
        new[first] = long[first]
        stop = long.copy()
        stop[:-1] &= ~long[1:]
        last = starts[1:][starts[1:] > 0] - 1
        stop[last] = long[last]
        begin, end = np.flatnonzero(new), np.flatnonzero(stop) + 1
        row = np.searchsorted(starts, begin, "right") - 1
        keep = single[row]
        begin, end, row = begin[keep], end[keep], row[keep]
        start, _ = _start_count(marks[row])
        shift = (start + begin - starts[row]).astype(np.uint64)
        out = shift << np.uint64(_COUNT_BITS) | (end - begin).astype(np.uint64)
        of_row = [table.column(c).combine_chunks().take(pa.array(row)) for c in (1, 2)]
        yield pa.RecordBatch.from_arrays([*of_row, pa.array(out.view(np.int64))], ["doc_id", "own", "mark"])

    def settled(parts: list[list]) -> pa.Table:
        return pa.Table.from_batches([batch.slice(first, stop - first) for batch, first, stop in parts])

    # Parts (batch, first row, row behind) of whole anchors, and of the last anchor, whose rows may go on in the next batch.
    held: list[list] = []
    tail: list[list] = []
    size = own = 0
    key = None
    for batch in batches:
        if not len(batch):
            continue
        anchors = np.asarray(batch.column(0))
        edges = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]])
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(batch.column(5)), dtype=np.int64))])
        weights = np.diff(ends[edges]).tolist()
        for anchor, first, stop, weight in zip(anchors[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), weights):
            if anchor == key:
                tail.append([batch, first, stop])
                own += weight
                continue
            # The last anchor is complete: it joins the others if the index stays within its bound.
            if held and size + own > INDEX_BYTES:
                yield from indexed(settled(held))
                held, size = [], 0
            if held and tail[0][0] is held[-1][0]:
                held[-1][2] = tail[0][2]
                held += tail[1:]
            else:
                held += tail
            size += own
            tail, own, key = [[batch, first, stop]], weight, anchor
    if held and size + own > INDEX_BYTES:
        yield from indexed(settled(held))
        held = []
    if held + tail:
        yield from indexed(settled(held + tail))


def beside_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts dealt by the bytes beside their anchor: up to two rows for each, with the hash of both as ``anchor``.

    Each row holds the part of the context with all windows that have ``SIDE`` bytes
    or more on that side; a context without such a window has no row.  Columns as in
    ``OPEN``.
    """
    for batch in batches:
        data, starts = S.text_bytes(batch.column(5))
        marks = np.asarray(batch.column(3)).view(np.uint64)
        for a, b in S.blocks(starts):
            part, at = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
            hashes = S.RunHash(S.BYTE_CODES[part], S.BASE)
            begin, end = at[:-1], at[1:]
            anchor = begin + ((marks[a:b] >> _PLACE_AT) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            first, _ = _start_count(marks[a:b])
            sides = (
                (anchor, anchor + ANCHOR + SIDE, np.maximum(begin, anchor - (WINDOW - ANCHOR - SIDE)), end),
                (anchor - SIDE, anchor + ANCHOR, begin, np.minimum(end, anchor + WINDOW - SIDE)),
            )
            for number, (left, right, low, high) in enumerate(sides):
                rows = np.flatnonzero((left >= begin) & (right <= end) & (high - low >= WINDOW))
                if not len(rows):
                    continue
                key = S.mix(hashes.of(left[rows], right[rows]) + np.uint64(number))
                start = (first + low - begin)[rows].astype(np.uint64)
                count = (high - low - WINDOW + 1)[rows].astype(np.uint64)
                pieces = [part[x:y].tobytes() for x, y in zip(low[rows].tolist(), high[rows].tolist())]
                take = lambda c: batch.column(c).slice(a, b - a).take(pa.array(rows))  # noqa: B023, E731
                mark = (start << np.uint64(_COUNT_BITS) | count).view(np.int64)
                columns = [pa.array(key.view(np.int64)), take(1), take(2), pa.array(mark), take(4), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "own", "mark", "single", "bytes"])


def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window of contexts: anchor, hash of the window, doc_id, own, mark of the window, single.

    Columns as in ``OPEN``.
    """
    for batch in batches:
        data, starts = S.text_bytes(batch.column(5))
        marks = np.asarray(batch.column(3)).view(np.uint64)
        for a, b in S.blocks(starts):
            part, at = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
            size = np.maximum(np.diff(at) - WINDOW + 1, 0)
            row = np.repeat(np.arange(b - a), size)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            begin = at[row] + shift
            window = S.RunHash(S.BYTE_CODES[part], S.BASE).of(begin, begin + WINDOW)
            start, _ = _start_count(marks[a:b][row])
            mark = (start + shift).astype(np.uint64) << np.uint64(_COUNT_BITS) | np.uint64(1)
            take = lambda c: batch.column(c).slice(a, b - a).take(pa.array(row))  # noqa: B023, E731
            columns = [take(0), pa.array(window.view(np.int64)), take(1), take(2), pa.array(mark.view(np.int64)), take(4)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "window", "doc_id", "own", "mark", "single"])


def hot_anchors(met: DataFrame) -> DataFrame:
    """Anchors whose open contexts are more than ``INDEX_BYTES``: at most one for so many bytes."""
    size = F.get("marks", F.lit(0)).bitwiseAND(F.lit((1 << _COUNT_BITS) - 1)) + WINDOW - 1
    return met.filter("indexed").groupBy("anchor").agg(F.sum(size).alias("size")).filter(F.col("size") > INDEX_BYTES).select("anchor")


def _pieces(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Contexts of ``runs`` as in ``OPEN``."""
    wanted = runs.groupBy(*ROW).agg(
        F.collect_set(F.struct("anchor", F.get("marks", F.lit(0)).alias("mark"), (~F.col("repeated")).alias("single"))).alias("runs")
    )
    return (
        docs.join(wanted, ROW)
        .select(*ROW, F.arrays_zip("runs", contexts("text", F.col("runs.mark")).alias("bytes")).alias("z"))
        .select(*ROW, F.explode("z").alias("z"))
        .select("z.runs.anchor", *ROW, "z.runs.mark", "z.runs.single", "z.bytes")
    )


def _indexed(pieces: DataFrame) -> DataFrame:
    """doc_id, own and mark of what the indexes of ``pieces`` find."""
    ordered = pieces.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(index_open, "doc_id long, own long, mark long")


def _found_in_hot(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, own and mark of windows of single contexts that another context of a hot anchor has."""
    # Not staged: within one query the texts that are shuffled for other contexts and for the cuts serve here as well.
    dealt = _pieces(docs, runs).mapInArrow(beside_anchor, OPEN)
    met = dealt.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bytes")).alias("size"))
    told = dealt.join(met.filter("n > 1").select("anchor", (F.col("size") > INDEX_BYTES).alias("large")), "anchor")
    windows = told.filter("large").drop("large").mapInArrow(open_windows, "anchor long, window long, doc_id long, own long, mark long, single boolean")
    again = F.count(F.lit(1)).over(W.partitionBy("anchor", "window")) > 1
    repeated = windows.withColumn("again", again).filter("again AND single").select(*ROW, "mark")
    return _indexed(told.filter("NOT large").drop("large")).unionByName(repeated)


@F.arrow_udf(StructType().add("n_bytes", LongType()).add("n_removed", LongType()).add("n_spans", LongType()).add("kept", BinaryType()))
def cut_bytes(texts: pa.Array, marks: pa.Array) -> pa.Array:
    """Byte counts, removed runs, and the bytes that stay."""
    out: list[list] = [[], [], [], []]
    for data, start, count in _rows(texts, np.asarray(marks.flatten()).view(np.uint64), _lengths(marks)):
        gone = S.cover(start, start + count + WINDOW - 1, len(data))
        for column, value in zip(out, (len(data), int(gone.sum()), S.count_runs(gone), data[~gone].tobytes())):
            column.append(value)
    arrays = [*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())]
    return pa.StructArray.from_arrays(arrays, ["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``documents``: doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay).

    Null and empty texts have no bytes.  Rows without an id are compared among
    themselves and with others like all rows; rows that share an id are judged
    by their own texts, and repeated rows are repeats of each other.  Removal may
    cut a character, so ``kept`` is binary.  Other columns are not read, an empty
    table gives an empty result.
    """
    docs = ids_and_texts(documents, doc_id, text).withColumns({"doc_id": F.coalesce("doc_id", F.lit(NO_ID)), "own": F.xxhash64("text")})
    of_anchor = W.partitionBy("anchor")
    in_order = of_anchor.orderBy("context", *ROW)
    same = lambda other: F.coalesce(other == F.col("context"), F.lit(False))
    met = stage(
        docs.mapInArrow(seed_runs, RUN_SCHEMA)
        .select(
            "anchor",
            *ROW,
            "marks",
            same(F.lag("context").over(in_order)).alias("_before"),
            same(F.lead("context").over(in_order)).alias("_after"),
            (F.min("context").over(of_anchor) != F.max("context").over(of_anchor)).alias("several"),
        )
        .select(
            "anchor",
            *ROW,
            "marks",
            (F.col("_before") | F.col("_after") | (F.size("marks") > 1)).alias("repeated"),
            # One copy of each context, where the anchor has others.
            (F.col("several") & ~F.col("_before")).alias("indexed"),
        )
        .filter("repeated OR indexed"),
        "repeats",
    )
    hot = stage(hot_anchors(met), "hot")
    runs = met.filter("indexed")
    # One row for each INDEX_BYTES of open contexts: Spark sees its size and broadcasts it while it is small.
    found = _indexed(_pieces(docs, runs.join(hot, "anchor", "left_anti")))
    if not hot.isEmpty():
        found = found.unionByName(_found_in_hot(docs, runs.join(hot, "anchor", "left_semi")))
    each = met.filter("repeated").select(*ROW, "marks").unionByName(found.select(*ROW, F.array("mark").alias("marks")))
    # Repeated rows have equal marks, so a set holds no more than one text has.
    marks = each.groupBy(*ROW).agg(F.flatten(F.collect_set("marks")).alias("marks"))
    cut = docs.join(marks, ROW, "left").select("doc_id", cut_bytes("text", F.coalesce("marks", F.array().cast(MARKS))).alias("c"))
    return cut.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "c.n_bytes", "c.n_removed", "c.n_spans", "c.kept")


#: Stands for a missing id inside this operator.
NO_ID = -(1 << 63)


def kept_digest(kept: str = "kept") -> Column:
    return F.sha2(F.col(kept), 256).alias("kept_sha256")
