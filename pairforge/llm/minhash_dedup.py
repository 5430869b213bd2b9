"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct ``WORDS``-word shingles.  Documents are
linked when ``100 * intersection >= 75 * union``.

Tensored banding: ``HALVES`` short hash collections of ``HASHES`` MinHashes
each are computed, and a table key is a *pair* of collections.  So
``HALVES * (HALVES - 1) / 2 = 276`` tables cost 48 MinHashes instead of 1,104.
Two sets at the threshold share a collection with probability 0.75 ** 2; they
miss all tables with probability 8e-8, closer ones with less.

1. Equal sets collapse to their smallest document by a 128-bit digest.
2. Collections that only one set has are dropped, so a text that resembles
   nothing makes no table keys.  The others are paired into keys.
3. In every bucket each set meets the bucket's smallest set.
4. Candidates whose sketch rules out a link are dropped (see ``likely``), the
   rest are compared on full shingle sets.  Links make components.
5. Buckets of three or more sets that still hold several components are
   searched for what step 3 left out: pairs of different components, by sketch.
   Rows are dealt by (bucket, block, block): a bucket's sets are cut into blocks
   of about ``BLOCK_SETS``, the largest component into blocks of its own, and
   every two blocks meet, except two of the largest component.  So no task holds
   a bucket.  A pair leaves a task only if its sketch allows a link and only
   from the first of the tables that it shares.  These pairs are compared on
   full sets, too, and the components are made anew.

So no bucket emits all its pairs: a group of thousands of copies costs one
comparison a copy and bucket.  Sketches take one value of each range of the
hash space, and have two to four ranges (``BINS`` to ``MOST_BINS`` in all) for
each shingle, so large sets of similarity 0.70 are told from those of 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

from pairforge.llm import spans as S
from pairforge.llm.components import components
from pairforge.llm.inputs import ids_and_texts
from pairforge.session import stage

WORDS = 5
SIMILAR = 75
HALVES, HASHES = 24, 2
#: Ranges of the hash space in a sketch, four bits each: the next power of two above twice the set's size, between these.
BINS, MOST_BINS = 512, 4096
#: Sets of one block of a bucket, in expectation.
BLOCK_SETS = 2048
#: Standard errors that a sketch may lie below the threshold.
SIGMAS = 5.0

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, signature binary, bins binary"
_N = HALVES * HASHES
_FLIP = S._RNG.integers(0, 1 << 64, _N, dtype=np.uint64)
_TURN = S._RNG.integers(0, 1 << 64, _N, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    words = S.find_words(data, offsets, S.NON_SPACE, lower=True)
    hashes = S.RunHash(words.hashes, S.WORD_BASE)
    sizes = np.diff(words.rows)
    out, ends = [], [0]
    for first, n in zip(words.rows[:-1].tolist(), sizes.tolist()):
        if n == 0:
            ends.append(ends[-1])
            continue
        k = min(n, WORDS)
        at = np.arange(first, first + n - k + 1)
        out.append(np.unique(hashes.of(at, at + k)))
        ends.append(ends[-1] + len(out[-1]))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(ends)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size, digest and MinHashes (32 bits each) of (doc_id, text) batches."""
    for batch in batches:
        data, offsets = S.text_bytes(batch.column(1))
        for a, b in S.blocks(offsets):
            values, ends = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            full = np.flatnonzero(np.diff(ends))
            at = ends[full]
            signature = np.zeros((b - a, _N), np.uint32)
            digest = np.zeros((2, b - a), np.uint64)
            if len(full):
                for k in range(_N):
                    least = np.minimum.reduceat((values ^ _FLIP[k]) * _TURN[k], at)
                    signature[full, k] = (S.mix(least) >> np.uint64(32)).astype(np.uint32)
                for k in range(2):
                    digest[k, full] = np.add.reduceat(S.mix(values ^ _TURN[k]), at)
            ranges = _ranges(np.diff(ends))
            first = np.concatenate([[0], np.cumsum(ranges)])
            nibbles = np.zeros(first[-1], np.uint8)
            row = np.repeat(np.arange(b - a), np.diff(ends))
            shift = (64 - np.log2(ranges).astype(np.int64)).astype(np.uint64)
            # Values ascend, so written backwards the least value of a range is the last one written.
            place = first[row] + (values >> shift[row]).astype(np.int64)
            nibbles[place[::-1]] = (1 + (values & np.uint64(0xFFFF)) % np.uint64(15)).astype(np.uint8)[::-1]
            bins = pa.py_buffer((nibbles[::2] << 4 | nibbles[1::2]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(ends)),
                    pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)),
                    _packed(signature.view(np.uint8)),
                    pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((first // 2).astype(np.int32)), bins]),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "signature", "bins"],
            )


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """Ranges of the sketches of sets of these sizes."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), BINS, MOST_BINS)


def _packed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    flat = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, flat]).cast(pa.binary())


def _bytes(values: pa.Array) -> np.ndarray:
    """Equally long binary values as rows of bytes."""
    data, _ = S.text_bytes(values)
    return data.reshape(len(values), -1) if len(values) else data.reshape(0, 1)


def _levels(bins: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Bytes of each sketch, and for each such size all sketches of at least that size, brought to it."""
    data, starts = S.text_bytes(bins)
    width = np.diff(starts)
    sizes = np.unique(width)
    levels = {int(w): np.zeros((len(width), w), np.uint8) for w in sizes}
    for w in sizes.tolist():
        of_size = np.flatnonzero(width == w)
        for k in range(0, len(of_size), 256):
            rows = of_size[k : k + 256]
            at = data[starts[rows][:, None] + np.arange(w)]
            levels[w][rows] = at
            while at.shape[1] > sizes[0]:
                # Two ranges become one: the value of the first of them that has one.
                at = np.where(at & 0xF0, at >> 4, at & 0x0F)
                at = at[:, ::2] << 4 | at[:, 1::2]
                if at.shape[1] in levels:
                    levels[at.shape[1]][rows] = at
    return width, levels


def likely(bins: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sketches allow a link between sets of ``n`` and ``m`` shingles.

    The sketch of a union is a sample without replacement of about one value a
    range.  At the threshold the equal ones are ``SIGMAS`` standard errors below
    their mean in fewer than one of a million cases.  Of different values in one
    range 1 of 15 are equal by chance: the others tell how many these are.
    """
    equal = np.zeros(len(bins), np.int64)
    used = np.zeros(len(bins), np.int64)
    differ = np.zeros(len(bins), np.int64)
    for mask in (0xF0, 0x0F):
        x, y = bins & mask, other & mask
        equal += ((x == y) & (x != 0)).sum(1)
        used += ((x | y) != 0).sum(1)
        differ += ((x != y) & (x != 0) & (y != 0)).sum(1)
    p = SIMILAR / 100
    union = np.maximum((n + m) / (1 + p), used)
    error = np.sqrt(used * p * (1 - p) * np.maximum((union - used) / np.maximum(union - 1, 1), 0.02))
    chance = differ / 14
    error = np.sqrt(error**2 + chance * 15 / 14)
    return (equal - chance >= p * used - SIGMAS * error - 1) & (100 * np.minimum(n, m) >= SIMILAR * np.maximum(n, m))


@F.arrow_udf(ArrayType(LongType()))
def half_keys(signatures: pa.Array) -> pa.Array:
    """The hash collections of a signature, one 64-bit key each."""
    halves = _bytes(signatures).view(np.uint32).reshape(-1, HALVES, HASHES).astype(np.uint64)
    keys = np.full(halves.shape[:2], 0, np.uint64) + np.arange(HALVES, dtype=np.uint64)
    for k in range(HASHES):
        keys = S.mix(keys * np.uint64(S.BASE) + halves[:, :, k])
    return pa.ListArray.from_arrays(
        np.arange(0, keys.size + 1, HALVES, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64))
    )


@F.arrow_udf(BooleanType())
def possible(a: pa.Array, n: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
    """``likely`` for two columns of sketches and set sizes."""
    n, m, out = np.asarray(n), np.asarray(m), np.zeros(len(a), bool)
    for at in range(0, len(a), 512):
        part = slice(at, at + 512)
        width, levels = _levels(pa.concat_arrays([a[part], b[part]]))
        half = len(width) // 2
        least = np.minimum(width[:half], width[half:])
        for w in np.unique(least).tolist():
            rows = np.flatnonzero(least == w)
            out[at + rows] = likely(levels[w][rows], n[at + rows], levels[w][half + rows], m[at + rows])
    return pa.array(out)


@F.arrow_udf(BooleanType())
def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether the full shingle sets of two texts are linked."""
    out, (x, at_x), (y, at_y) = [], S.text_bytes(a), S.text_bytes(b)
    for i in range(len(a)):
        one, _ = shingle_sets(x[at_x[i] : at_x[i + 1]], np.array([0, at_x[i + 1] - at_x[i]]))
        two, _ = shingle_sets(y[at_y[i] : at_y[i + 1]], np.array([0, at_y[i + 1] - at_y[i]]))
        both = len(np.intersect1d(one, two, assume_unique=True))
        out.append(both > 0 and 100 * both >= SIMILAR * (len(one) + len(two) - both))
    return pa.array(out, pa.bool_())


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are linked."""
    of = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(similar("text_a", "text_b")).select("a", "b")


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible links of rows sorted by bucket, x, y: bucket, x, y, own, i, j, rep, component, n_shingles, signature, bins.

    Where ``x`` is ``y`` all sets of the block meet, else those of block ``x``
    those of block ``y``.  Sets of one component are not compared with each other.
    """

    def within(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, x, y, own, i, j, rep, comp, n = (np.asarray(table.column(c)) for c in range(9))
        halves = np.ascontiguousarray(_bytes(table.column(9).combine_chunks())).view(np.uint64)  # HASHES of 32 bits are one number
        bins = table.column(10).combine_chunks()
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            _, code, size = np.unique(comp[a:b], return_inverse=True, return_counts=True)
            inside = x[a] == y[a]
            # Every pair once: inside a block with all of the largest component, and with later rows of the others.
            far = code == size.argmax() if inside else own[a:b] == y[a]
            sketches, left, right = None, [], []
            for row in np.flatnonzero(~far).tolist():
                other = np.flatnonzero((code != code[row]) & (far | (np.arange(b - a) > row) if inside else far))
                shared = halves[a + other] == halves[a + row]
                earlier = shared[:, : j[a + row]].sum(1) - shared[:, i[a + row]]
                other = other[(earlier == 0) & shared[:, i[a + row]] & shared[:, j[a + row]]]
                if not len(other):
                    continue
                width, levels = sketches = sketches or _levels(bins.slice(a, b - a))
                least = np.minimum(width[other], width[row])
                for w in np.unique(least).tolist():
                    those = other[least == w]
                    same = np.broadcast_to(levels[w][row], (len(those), w))
                    those = those[likely(levels[w][those], n[a + those], same, n[a + row])]
                    left.append(np.full(len(those), rep[a + row]))
                    right.append(rep[a + those])
            if left:
                p, q = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    key = lambda batch, row: tuple(batch.column(c)[row].as_py() for c in range(3))
    for batch in batches:
        if not len(batch):
            continue
        same = [np.asarray(batch.column(c)) == batch.column(c)[-1].as_py() for c in range(3)]
        start = int(np.logical_and.reduce(same).argmax())
        if start or (held and key(held[-1], -1) != key(batch, 0)):
            yield from within(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = []
        held.append(batch.slice(start))
    if held:
        yield from within(pa.Table.from_batches(held))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (bucket, rep, component, ...) of buckets with several components: own block, and x and y of every meeting."""
    counted = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        counted.groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"))
        .filter("n > 2 AND main.n < n")
        .select(
            "bucket",
            F.col("main.component").alias("main"),
            # Blocks of other sets and, behind them, of the largest component; a small bucket is one block.
            F.greatest(F.ceil((F.col("n") - F.col("main.n")) / BLOCK_SETS), F.lit(1)).cast("int").alias("others"),
            F.when(F.col("n") > BLOCK_SETS, F.ceil(F.col("main.n") / BLOCK_SETS)).otherwise(0).cast("int").alias("mains"),
        )
    )
    in_main = (F.col("component") == F.col("main")) & (F.col("mains") > 0)
    block = lambda count: F.pmod(F.xxhash64("rep"), count).cast("int")
    own = F.when(in_main, F.col("others") + block(F.greatest("mains", F.lit(1)))).otherwise(block(F.col("others")))
    met = F.sequence(F.lit(0), F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    return (
        rows.join(mixed, "bucket")
        .withColumn("own", own)
        .withColumn("met", F.explode(met))
        .withColumns({"x": F.least("own", "met"), "y": F.greatest("own", "met")})
        .drop("main", "others", "mains", "met")
    )


def _left_out(buckets: DataFrame, reps: DataFrame, found: DataFrame, tried: DataFrame) -> DataFrame:
    """Candidates of different components that never met: both in a bucket, neither its smallest set."""
    rows = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sketches = reps.select("rep", "n_shingles", "signature", "bins")
    pairs = (
        _dealt(rows)
        .join(sketches, "rep")
        .select("bucket", "x", "y", "own", "i", "j", "rep", "component", "n_shingles", "signature", "bins")
        .repartition("bucket", "x", "y")
        .sortWithinPartitions("bucket", "x", "y")
        .mapInArrow(_bucket_pairs, "a long, b long")
        .distinct()
    )
    return pairs.join(tried, ["a", "b"], "left_anti")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents``.

    Null, empty and blank texts have no shingles and are linked with nothing.
    A row without id is linked with nothing, has no component and is kept.
    Repeated rows are equal sets and so one component; of rows that share an id
    but not the text each is judged by its own.  Other columns are not read.
    """
    docs = ids_and_texts(documents, doc_id, text)
    signed = stage(docs.mapInArrow(sign, SIGNATURE_SCHEMA), "signatures")
    usable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    sets = ["n_shingles", "d1", "d2"]
    reps = stage(usable.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("bins").alias("bins")), "sets")

    halves = reps.select("rep", F.posexplode(half_keys("signature")).alias("i", "half"))
    common = halves.groupBy("half").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("half")
    shared = halves.join(common, "half").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("i", "half"))).alias("halves"))
    tables = shared.select("rep", F.posexplode("halves").alias("at", "first"), "halves").select(
        "rep", "first", F.explode(F.slice("halves", F.col("at") + 2, HALVES)).alias("second")
    )
    keyed = tables.select(
        F.xxhash64("first.half", "second.half").alias("bucket"),
        F.col("first.i").cast("byte").alias("i"),
        F.col("second.i").cast("byte").alias("j"),
        "rep",
    )
    pivots = keyed.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("high")).filter("pivot < high").select("bucket", "pivot")
    buckets = stage(keyed.join(pivots, "bucket"), "buckets")

    met = buckets.filter("rep > pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    facts = reps.select("rep", "n_shingles", "bins")
    tried = stage(
        met.join(facts.toDF("a", "n_a", "s_a"), "a")
        .join(facts.toDF("b", "n_b", "s_b"), "b")
        .filter(possible("s_a", "n_a", "s_b", "n_b"))
        .select("a", "b"),
        "candidates",
    )
    texts = docs.filter("doc_id IS NOT NULL")
    links = stage(_verified(tried, texts), "links")
    found = components(links)
    more = stage(_left_out(buckets.drop("pivot"), reps, found, tried), "candidates")
    if not more.isEmpty():
        # The components so far are stars already; only new links have to be taken in.
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(stars.unionByName(_verified(more, texts)))

    of_set = reps.select(*sets, "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = usable.select("doc_id", *sets).join(of_set.select(*sets, F.coalesce("component", "rep").alias("component_id")), sets)
    alone = signed.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = labelled.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
