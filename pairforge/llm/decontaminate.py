"""Benchmark decontamination by winnowing.

Benchmark items and documents are lower-cased and cut into words.  A window is
``WINDOW`` words; it chooses the least of its ``GRAM``-word grams as its
fingerprint, so any window that an item and a document share gives both the
same fingerprint at the same place.  Document fingerprints are looked up among
those of the benchmark, hits are extended to their windows, and the windows are
compared.  An item of fewer words than a window is one window of its own
length and its own fingerprint.

The fingerprints of the benchmark are broadcast up to ``BROADCAST_WINDOWS``
windows (counted first); then documents need no shuffle at all.  Beyond that
bound fingerprints and windows are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm import spans as S
from pairforge.llm.inputs import fresh, or_empty

WINDOW = 10
GRAM = 5
#: 24 bytes each on every executor.
BROADCAST_WINDOWS = 1 << 20

SEEDS = "array<struct<anchor: long, window: long, pos: int, size: int>>"
HITS = "n_words long, n_hit long, items array<string>"


class _Block:
    """Words, gram hashes and runs of some consecutive texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = words = S.find_words(data, offsets, S.ALNUM, lower=True)
        self.hashes = S.RunHash(words.hashes, S.WORD_BASE)
        self.left = np.repeat(words.rows[1:], np.diff(words.rows)) - np.arange(len(words.starts))
        self.grams = self.of(GRAM)
        self.runs = S.winnow(self.grams, WINDOW - GRAM + 1, self.left >= WINDOW)

    def of(self, size: int) -> np.ndarray:
        """Hashes of all grams of ``size`` words, also across texts."""
        places = np.arange(max(0, len(self.left) - size + 1))
        return self.hashes.of(places, places + size)

    def inside(self, size: int) -> np.ndarray:
        return np.flatnonzero(self.left >= size)

    def row(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.rows, places, "right") - 1


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, _Block]]:
    data, offsets = S.text_bytes(texts)
    for a, b in S.blocks(offsets):
        yield a, b, _Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _lists(rows: np.ndarray, n: int, fields: dict[str, np.ndarray]) -> pa.Array:
    """A list of structs for each of ``n`` texts; ``rows`` says to which text each element belongs."""
    order = np.argsort(rows, kind="stable")
    columns = [pa.array(v[order]) for v in fields.values()]
    offsets = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, list(fields)))


def _seeds(texts: pa.Array, short: tuple[int, ...] | None) -> pa.Array:
    """Fingerprint, hash, place and size of every window; ``short``: sizes besides ``WINDOW``, None: own size."""
    out = []
    for a, b, block in _blocks(texts):
        runs = block.runs
        places = _expand(runs.first, runs.count)
        parts = [(np.repeat(block.grams[runs.anchor], runs.count), block.hashes.of(places, places + WINDOW), places, WINDOW)]
        if short is None:
            sizes = np.diff(block.words.rows)
            for size in np.unique(sizes[(sizes > 0) & (sizes < WINDOW)]):
                at = block.words.rows[:-1][sizes == size]
                parts.append((block.hashes.of(at, at + size), block.hashes.of(at, at + size), at, int(size)))
        for size in short or ():
            at = block.inside(size)
            parts.append((block.hashes.of(at, at + size), block.hashes.of(at, at + size), at, size))
        for anchor, window, at, size in parts:
            row = block.row(at)
            out.append((row + a, anchor, window, (at - block.words.rows[row]).astype(np.int32), np.full(len(at), size, np.int32)))
    empty = (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int32),) * 2)
    rows, anchor, window, pos, size = (np.concatenate(x) for x in zip(empty, *out))
    return _lists(rows, len(texts), {"anchor": anchor.view(np.int64), "window": window.view(np.int64), "pos": pos, "size": size})


class _Index:
    """Benchmark windows by size, sorted by hash."""

    def __init__(self, windows: pa.Table):
        self.items = windows.column("item_id").combine_chunks().dictionary_encode()
        code = np.asarray(self.items.indices)
        anchor, window, size = (np.asarray(windows.column(c)) for c in ("anchor", "window", "size"))
        self.anchors = np.unique(anchor[size == WINDOW].view(np.uint64))
        self.names = self.items.dictionary
        self.by_size = {}
        for n in np.unique(size):
            own = window[size == n].view(np.uint64)
            order = np.argsort(own, kind="stable")
            self.by_size[int(n)] = own[order], code[size == n][order]

    def __getstate__(self):
        return self.anchors, self.names, self.by_size

    def __setstate__(self, state):
        self.anchors, self.names, self.by_size = state

    def look_up(self, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place and size of each hit; place and item of each hit with each of its items."""
        at, sizes, where, items = [], [], [], []
        for size, (known, code) in self.by_size.items():
            if size == WINDOW:
                runs = block.runs
                hit = _isin(block.grams[runs.anchor], self.anchors)
                places = _expand(runs.first[hit], runs.count[hit])
            else:
                places = block.inside(size)
            window = block.hashes.of(places, places + size)
            low, high = np.searchsorted(known, window), np.searchsorted(known, window, "right")
            found = high > low
            count = (high - low)[found]
            at.append(places[found])
            sizes.append(np.full(len(count), size))
            where.append(np.repeat(places[found], count))
            items.append(code[_expand(low[found], count)])
        none = [np.zeros(0, np.int64)]
        return tuple(np.concatenate(x + none) for x in (at, sizes, where, items))


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """anchor, window, size and item_id (as string) of every window; repeated ones once."""
    seeds = F.arrow_udf(lambda texts: _seeds(texts, None), SEEDS)
    return (
        benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.explode(seeds(text)).alias("w"))
        .select("w.anchor", "w.window", "w.size", "item_id")
        .distinct()
    )


def _broadcast_hits(documents: DataFrame, windows: pa.Table, text: str, out: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(_Index(windows))

    def find(texts: pa.Array) -> pa.Array:
        index = shared.value
        totals, hits, codes, sizes = [], [], [], []
        for a, b, block in _blocks(texts):
            at, size, where, item = index.look_up(block)
            hit = S.cover(at, at + size, len(block.left))
            before = np.concatenate([[0], np.cumsum(hit)])
            rows = block.words.rows
            totals.append(np.diff(rows))
            hits.append(np.diff(before[rows]))
            pairs = np.unique(np.stack([block.row(where), item]), axis=1)
            codes.append(pairs[1])
            sizes.append(np.bincount(pairs[0], minlength=b - a))
        none = [np.zeros(0, np.int64)]
        flat = index.names.take(pa.array(np.concatenate(codes + none).astype(np.int64)))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes + none))]).astype(np.int32)
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(totals + none)), pa.array(np.concatenate(hits + none)), pa.ListArray.from_arrays(offsets, flat)],
            ["n_words", "n_hit", "items"],
        )

    return documents.withColumn(out, F.arrow_udf(find, HITS)(text))


def _joined_hits(documents: DataFrame, windows: DataFrame, text: str, out: str) -> DataFrame:
    """The same by joins, for a benchmark of any size; texts are told apart by a digest."""
    short = tuple(r[0] for r in windows.filter(F.col("size") < WINDOW).select("size").distinct().collect())
    seeds = F.arrow_udf(lambda texts: _seeds(texts, short), SEEDS)
    count = F.arrow_udf(lambda texts: pa.array([n for _, _, b in _blocks(texts) for n in np.diff(b.words.rows)], pa.int64()), "long")
    key = fresh(documents, "_key")
    keyed = documents.withColumn(key, F.sha2(or_empty(text), 256))
    found = (
        keyed.select(F.col(key).alias("_key"), F.col(text).alias("text"))
        .distinct()
        .select("_key", F.explode(seeds("text")).alias("w"))
        .select("_key", "w.*")
        .join(windows.select("anchor").distinct(), "anchor", "left_semi")
        .join(windows.select("window", "size", "item_id"), ["window", "size"])
    )
    covered = found.select("_key", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()
    n_hit = covered.groupBy("_key").agg(F.count(F.lit(1)).alias("_n_hit"))
    items = found.groupBy("_key").agg(F.collect_set("item_id").alias("_items"))
    facts = n_hit.join(items, "_key").withColumnRenamed("_key", key)
    result = F.struct(
        count(text).alias("n_words"),
        F.coalesce("_n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
    )
    return keyed.join(facts, key, "left").withColumn(out, result).drop(key, "_n_hit", "_items")


def find_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    out: str = "found",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Add the struct ``out`` of n_words, n_hit and items (ids as strings) to every row of ``documents``.

    Null and empty texts have no words.  Items without words are found nowhere;
    items that share an id count as one.  Repeated rows are judged alike, other
    columns are kept, one of the name ``out`` is replaced, and an empty table on
    either side finds nothing.
    """
    windows = benchmark_windows(benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()))
    if windows.count() <= broadcast_windows:
        return _broadcast_hits(documents, windows.toArrow(), text, out)
    return _joined_hits(documents, windows, text, out)


def summary(found: str = "found") -> list[Column]:
    """Counts, digest and verdict of a row of ``find_benchmark``."""
    items = F.array_sort(F.col(found)["items"])
    return [
        F.col(found).n_words.alias("n_words"),
        F.col(found).n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col(found).n_hit > 0).alias("contaminated"),
    ]
