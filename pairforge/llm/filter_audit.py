"""How five document filters interact, from a sparse document-term matrix.

1. Texts are split into words and dictionary-encoded segment by segment (tens of
   MB of text).  A segment's shards hold their rows' word counts in compressed
   sparse rows over the segment's words, and the facts of each row that need no words.
2. The words of all segments meet by word, once, sorted: equal ones get one
   number, numbers are made dense, and each segment receives the numbers of its
   words (a word meets a segment once, so no word is hot) and rewrites the column
   indices of its shards.  ``document_term_matrix`` ends here.
3. A row's sum is its number of words, its number of nonzeros that of distinct
   words: they decide filters A and B.  C and D come with the row, E from the
   least id among equal texts.
4. Documents are counted by part, filters failed and labels; every order of the
   filters is worked out from those few counts.

Texts are read once and never shuffled; equal texts are told by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairforge.llm.inputs import or_empty
from pairforge.llm.spans import text_bytes
from pairforge.session import stage

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
#: Fixed set of filter D.
SYMBOLS = b"#$%&*|"
#: Text bytes of a shard (one longer text is a shard of its own), and of the shards that share a dictionary.
SHARD_BYTES, SEGMENT_BYTES = 2 << 20, 24 << 20
#: Segments of a task, and words of a segment, are below these powers of two; both go into one long (``place``).
SEGMENT_BITS, WORD_BITS = 12, 31
#: Bytes of a Parquet row group of shards, so that a reader holds few shards at once.
GROUP_BYTES = 16 << 20

UPPER = bytes(range(0x41, 0x5B))

_ROWS = "doc_ids array<bigint>, parts array<string>, marks array<int>, digests array<binary>"
#: Shards as they are written first (arrays as bytes), or with ``words`` alone the dictionary of a segment.
LOCAL = f"segment bigint, {_ROWS}, indptr binary, indices binary, counts binary, words array<string>"
MATRIX = f"segment bigint, {_ROWS}, indptr array<int>, indices array<bigint>, counts array<int>"
_MARK_C, _MARK_D = 1 << 2, 1 << 3


def _ranges(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _facts(texts: pa.Array, data: bytes, at: np.ndarray) -> list[pa.Array]:
    """Bits of the filters C and D of each row, and the digests of the texts."""
    points = np.asarray(pc.utf8_length(texts))
    marks, digests = [], []
    for n, a, b in zip(points.tolist(), at[:-1].tolist(), at[1:].tolist()):
        text = data[a:b]
        upper, plain = len(text) - len(text.translate(None, UPPER)), len(text.translate(None, SYMBOLS))
        marks.append((100 * upper > UPPER_PERCENT * n) * _MARK_C + (plain < len(text)) * _MARK_D)
        digests.append(hashlib.sha256(text).digest())
    return [pa.array(marks, pa.int32()), pa.array(digests, pa.binary())]


def _compress(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row pointers, column numbers and counts of the words of ``texts``, and the words."""
    split = pc.ascii_split_whitespace(texts)
    rows = np.repeat(np.arange(len(texts)), np.asarray(split.value_lengths()))
    flat = split.flatten()
    # Space at the ends of a text leaves empty pieces.
    real = pc.not_equal(flat, "")
    encoded = flat.filter(real).dictionary_encode()
    cells, counts = np.unique((rows[np.asarray(real)] << 32) + np.asarray(encoded.indices), return_counts=True)
    indptr = np.searchsorted(cells >> 32, np.arange(len(texts) + 1))
    return indptr.astype(np.int32), (cells & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32), encoded.dictionary


_WIDTHS = (np.uint8, np.uint16, np.uint32)


def _narrow(values: np.ndarray) -> bytes:
    """Values as bytes of the least width that holds them, after the number of that width."""
    width = next(w for w, kind in enumerate(_WIDTHS) if not len(values) or values.max() <= np.iinfo(kind).max)
    return bytes([width]) + values.astype(_WIDTHS[width]).tobytes()


def _wide(value: pa.Scalar) -> np.ndarray:
    data = value.as_buffer()
    return np.frombuffer(data[1:], _WIDTHS[data[0]])


class _Segment:
    """Consecutive shards that wait for their common dictionary."""

    def __init__(self):
        self.bytes, self.facts, self.rows, self.words = 0, [], [], []

    def add(self, size: int, facts: list[pa.Array], texts: pa.Array) -> None:
        *rows, words = _compress(texts)
        self.bytes += size
        self.facts.append(facts)
        self.rows.append(rows)
        self.words.append(words)

    def written(self, number: int) -> Iterator[pa.RecordBatch]:
        """The shards with numbers of the common dictionary, then that."""
        common = pa.concat_arrays(self.words).dictionary_encode()
        numbers, first = np.asarray(common.indices), 0
        key = pa.array([number], pa.int64())
        for facts, (indptr, indices, counts), words in zip(self.facts, self.rows, self.words):
            rows = (indptr, numbers[first : first + len(words)][indices], counts)
            first += len(words)
            packed = [pa.array([_narrow(x)], pa.binary()) for x in rows]
            yield pa.RecordBatch.from_arrays([key, *map(_one, facts), *packed, pa.nulls(1, pa.list_(pa.string()))], _NAMES)
        lists = [pa.nulls(1, pa.list_(t)) for t in (pa.int64(), pa.string(), pa.int32(), pa.binary())]
        blobs = [pa.nulls(1, pa.binary())] * 3
        yield pa.RecordBatch.from_arrays([key, *lists, *blobs, _one(common.dictionary)], _NAMES)


_NAMES = ["segment", "doc_ids", "parts", "marks", "digests", "indptr", "indices", "counts", "words"]


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _local_shards(batches: Iterator[pa.RecordBatch], shard_bytes: int, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, text) to shards and dictionaries; a segment's number is unique among the attempts that count."""
    number, segment = TaskContext.get().partitionId() << SEGMENT_BITS, _Segment()
    for batch in batches:
        ids, parts, texts = batch.columns
        raw, offsets = text_bytes(texts)
        for first, last in _ranges(offsets, shard_bytes):
            size = int(offsets[last] - offsets[first])
            if segment.bytes and segment.bytes + size > segment_bytes:
                yield from segment.written(number)
                number, segment = number + 1, _Segment()
            own = texts.slice(first, last - first).cast(pa.string())
            data, at = raw[offsets[first] : offsets[last]].tobytes(), offsets[first : last + 1] - offsets[first]
            facts = [ids.slice(first, last - first), parts.slice(first, last - first), *_facts(own, data, at)]
            segment.add(size, facts, own)
    if segment.rows:
        yield from segment.written(number)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, word) in order of words: equal words get one number; the word stays with its first row."""
    before, number = None, (TaskContext.get().partitionId() << 33) - 1
    for batch in batches:
        places, words = batch.columns
        if not len(words):
            continue
        new = np.ones(len(words), bool)
        new[0] = words[0].as_py() != before
        new[1:] = np.asarray(pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)))
        numbers = number + np.cumsum(new)
        before, number = words[len(words) - 1].as_py(), int(numbers[-1])
        named = pc.if_else(pa.array(new), words, pa.scalar(None, words.type))
        yield pa.RecordBatch.from_arrays([places, pa.array(numbers), named], ["place", "raw", "word"])


def _numbered(used: DataFrame) -> DataFrame:
    """Add dense numbers 0, 1, ... of the words: their place in a partition, after the words of those before."""
    ordered = used.repartition("word").sortWithinPartitions("word")
    numbers = stage(ordered.mapInArrow(_number, "place bigint, raw bigint, word string"), "numbers", compression="zstd")
    task, rank = F.shiftright("raw", 33), F.col("raw").bitwiseAND((1 << 33) - 1)
    # One row for each partition that was written.
    sizes = numbers.groupBy(task.alias("task")).agg((F.max(rank) + 1).alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = F.broadcast(sizes.select("task", ahead.alias("before")))
    return numbers.withColumn("task", task).join(before, "task").select("place", (F.col("before") + rank).alias("word_id"), "word")


def _renumber(numbers: pa.Table, shards: pa.Table) -> pa.Table:
    """The shards of one segment with global column indices."""
    local = np.asarray(numbers["place"]) & ((1 << WORD_BITS) - 1)
    of = np.zeros(len(local), np.int64)
    of[local] = np.asarray(numbers["word_id"])
    out = []
    for shard in range(len(shards)):
        row = shards.slice(shard, 1)
        indptr, indices, counts = (_wide(row[c][0]) for c in ("indptr", "indices", "counts"))
        kept = [row[c].combine_chunks() for c in ("of", "doc_ids", "parts", "marks", "digests")]
        arrays = (indptr.astype(np.int32), of[indices], counts.astype(np.int32))
        out.append(pa.Table.from_arrays([*kept, *[_one(pa.array(x)) for x in arrays]], _NAMES[:-1]))
    return pa.concat_tables(out)


def _row_sums(matrix: pa.Table) -> pa.Table:
    """For each row of the matrix its document, the sum of the row and the number of its nonzeros."""
    facts = [matrix[c].combine_chunks().flatten() for c in ("doc_ids", "parts", "marks", "digests")]
    sums, nonzeros = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for pointers, values in zip(matrix["indptr"], matrix["counts"]):
        at = np.asarray(pointers.values)
        sums.append(np.diff(np.concatenate([[0], np.cumsum(np.asarray(values.values), dtype=np.int64)])[at]))
        nonzeros.append(np.diff(at).astype(np.int64))
    pa.default_memory_pool().release_unused()
    numbers = [pa.array(np.concatenate(x)) for x in (sums, nonzeros)]
    return pa.Table.from_arrays([*facts, *numbers], ["doc_id", "part", "mark", "digest", "n_words", "n_distinct"])


@dataclass(frozen=True)
class Matrix:
    """Document-term matrix in shards, and the numbers of its words."""

    numbers: DataFrame
    shards: DataFrame

    def dictionary(self) -> DataFrame:
        """``word`` and ``word_id``, from 0 on."""
        return self.numbers.filter("word IS NOT NULL").select("word", "word_id")

    def _with_numbers(self, work, schema: str) -> DataFrame:
        numbers = self.numbers.select("place", "word_id")
        return numbers.groupBy(F.shiftright("place", WORD_BITS).alias("segment")).cogroup(self.shards.groupBy("of")).applyInArrow(work, schema)

    def csr(self) -> DataFrame:
        """Shards with, for their documents in order, ``doc_ids``, ``parts``, ``marks`` (bits of C and D) and
        ``digests`` of the texts, and the matrix as ``indptr``, ``indices`` (global) and ``counts``."""
        return self._with_numbers(lambda numbers, shards: _renumber(numbers, shards), MATRIX)

    def row_statistics(self) -> DataFrame:
        """``doc_id, part, mark, digest`` of each row with ``n_words`` (its sum) and ``n_distinct`` (its nonzeros)."""
        schema = "doc_id bigint, part string, mark int, digest binary, n_words bigint, n_distinct bigint"
        return self._with_numbers(lambda numbers, shards: _row_sums(_renumber(numbers, shards)), schema)


def document_term_matrix(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    shard_bytes: int = SHARD_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
) -> Matrix:
    """Word counts of every row of ``documents`` over one dictionary of all words.

    Null texts are empty rows, a null part is the empty string; every row of the
    table, repeated or without id, is a row of the matrix.  Shards and numbers are
    written to the shared folder.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), or_empty(F.col(part).cast("string")).alias("part"), or_empty(text).alias("text"))
    build = partial(_local_shards, shard_bytes=shard_bytes, segment_bytes=segment_bytes)
    local = stage(rows.mapInArrow(lambda batches: build(batches), LOCAL), "shards", **{"parquet.block.size": str(GROUP_BYTES), "compression": "zstd"})
    words = local.filter("words IS NOT NULL").select("segment", F.posexplode("words").alias("local", "word"))
    words = words.select(F.shiftleft("segment", WORD_BITS).bitwiseOR(F.col("local").cast("long")).alias("place"), "word")
    return Matrix(_numbered(words), local.filter("words IS NULL").drop("words").withColumnRenamed("segment", "of"))


def failed(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by ``part``, ``fails`` (bit k: the k-th filter), with ``n``, ``n_good`` and ``n_toxic``.

    A document without id has no smaller and no equal id, and no label; one with
    several labels is good or toxic if any says so.
    """
    few = (F.col("n_words") < MIN_WORDS).cast("int")
    same = (100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")).cast("int")
    bits = F.col("mark") + few + 2 * same
    rows = statistics.groupBy("doc_id", "digest", "part", bits.alias("fails")).agg(F.count(F.lit(1)).alias("n"))
    # A key of its own kind spreads rows without id, which match nothing.
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-#"), F.hex("digest")))
    good, toxic = (F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")) for c in ("quality", "toxic"))
    told = (
        labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)")
        .groupBy(F.col("doc_id").cast("long").cast("string").alias("key"))
        .agg(good.alias("good"), toxic.alias("toxic"))
    )
    known = rows.withColumn("key", key).join(told, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # Equal texts fail A to D alike, so what is left of a text is one row for each part and label.
    texts = known.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_without"),
        F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"),
    )
    first = F.min("least").over(W.partitionBy("digest"))
    alone = F.col("n_without") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = texts.withColumn("first", first).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("fails").alias("fails"), alone.alias("n")),
            F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - alone).alias("n")),
        )).alias("x"),
    )
    return split.groupBy("part", F.col("x.fails").alias("fails")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("n_good"), F.sum(F.col("x.n") * F.col("toxic")).alias("n_toxic")
    )


def interactions(counts: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, from the counts of ``failed``: 600 rows for each part."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    # At most 32 counts for a part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "n_good", "n_toxic")).alias("cells"))
    steps = (
        parts.withColumn("filter_order", F.explode(F.lit(orders)))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("own", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
        .withColumn("before", F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (m, i) -> m + if(i < step, shiftleft(1, ascii(substring(filter_order, i, 1)) - 65), 0))"))
    )
    own, before = F.col("own"), F.col("before")

    def total(holds, value=lambda x: x.n) -> Column:
        return F.aggregate(F.filter("cells", holds), F.lit(0).cast("long"), lambda acc, x: acc + value(x))

    fails = lambda x: x.fails.bitwiseAND(own) != 0
    earlier = lambda x: x.fails.bitwiseAND(before) != 0
    removed = lambda x: fails(x) & ~earlier(x)
    # A document that fails k filters is removed by each of them in one of k orders.
    share = lambda x: x.n * F.floor(F.lit(len(orders)) / F.bit_count(x.fails))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~earlier(x)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda x: fails(x) & earlier(x)).alias("redundant"),
        total(lambda x: x.fails == own).alias("unique_fails"),
        total(removed, lambda x: x.n_good).alias("good_lost"),
        total(removed, lambda x: x.n_toxic).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The interaction of the five filters in every part of ``documents``; see ``interactions``.

    Null texts count as empty, a null part as the empty string; repeated rows
    count as often as they occur, further columns are ignored, and an empty table
    has no parts.
    """
    matrix = document_term_matrix(documents, doc_id, text, part)
    return interactions(failed(matrix.row_statistics(), labels))
