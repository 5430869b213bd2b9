"""Evaluation: rank correlation of cosine and label, and in-batch retrieval."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from pairforge import constants as K
from pairforge.functions.prompts import Prompts
from pairforge.functions.text import in_language
from pairforge.functions.vectors import row_dot, to_matrix
from pairforge.operators.lookup import attach_vectors
from pairforge.operators.ordering import BUCKET_ROWS, dense_position, example_position
from pairforge.operators.skew import hot_keys_of, skew_join
from pairforge.schemas import ORDER_KEY
from pairforge.session import stage

# Distinct values that one task ranks; ranges a sketch is cut into at once; size of a quantile sketch (rank error 0.1 %).
RANGE_ROWS, FAN, SKETCH = 1 << 16, 256, 4096
# Passages per block of the retrieval score matrix, pivots that deal them, bytes of all blocks' centres.
BLOCK, PIVOTS, BALL_BYTES = 256, 64, 1 << 26


def sts_pairs(
    examples: DataFrame, languages: Sequence[str], prompts: Prompts | None = None
) -> DataFrame:
    """Labelled sentence pairs per language prefix.

    Side a carries its own student prompt, side b is read as a plain document.
    An example that matches several prefixes counts for each.
    """
    prompts = prompts or Prompts()
    matches = F.array_compact(
        F.array(*[F.when(in_language(F.col("lang"), p), F.lit(p)) for p in languages])
    )
    usable = examples.filter(
        (F.col("task") == "sts") & F.col("label").isNotNull() & (F.size("texts") >= 2)
    )
    first = lambda c, i: F.get(F.col(c), F.lit(i))
    return usable.select(
        *ORDER_KEY,
        F.explode(matches).alias("lang"),
        "label",
        first("text_ids", 0).alias("a_id"),
        first("text_ids", 1).alias("b_id"),
        prompts.student_text(first("student_prompt_names", 0), first("texts", 0)).alias("a_text"),
        prompts.student_text(F.lit("document"), first("texts", 1)).alias("b_text"),
    )


def keyed_by_text(rows: DataFrame, **ids: str) -> DataFrame:
    """Replace ids by the hash of the prompted text they stand for, e.g. ``a_id="a_text"``.

    The key of vectors that are encoded from prompted texts.
    """
    return rows.withColumns({name: F.sha1(F.col(text)) for name, text in ids.items()})


def texts_to_encode(*rows: tuple[DataFrame, str, str]) -> DataFrame:
    """Distinct ``(text_id, text, kind)`` of several (frame, id column, text column)."""
    parts = [df.select(F.col(i).alias("text_id"), F.col(t).alias("text")) for df, i, t in rows]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.dropDuplicates(["text_id"]).withColumn("kind", F.lit("doc"))


def pair_similarity(
    pairs: DataFrame, embeddings: DataFrame, hot: Mapping | None = None
) -> DataFrame:
    """Dot product of the unit vectors of ``a_id`` (query kind) and ``b_id`` (document kind).

    Both sides go through one lookup in long form, then meet again by example.
    """
    keys = [*ORDER_KEY, "lang", "label"]
    side = lambda i, c: F.struct(F.lit(i).alias("side"), F.col(c).alias("text_id"))
    refs = pairs.select(*keys, F.explode(F.array(side(0, "a_id"), side(1, "b_id"))).alias("_r")).select(
        *keys, "_r.side", "_r.text_id", (F.col("_r.side") == 0).alias("is_a")
    )
    found = attach_vectors(refs, {"vec": (embeddings, "is_a")}, [*ORDER_KEY, "side"], hot)
    on_side = lambda i: F.any_value(F.when(F.col("side") == i, F.col("vec")), F.lit(True))
    both = found.groupBy(*keys).agg(on_side(0).alias("_a"), on_side(1).alias("_b"))
    return (
        both.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .withColumn("sim", row_dot("_a", "_b"))
        .drop("_a", "_b")
    )


def _below(cuts: str, value: str) -> Column:
    """How many of the sorted ``cuts`` are below ``value``: whole chunks first, then inside one chunk."""
    chunk = math.isqrt(FAN)
    is_below = lambda c: c < F.col(value)
    ends = F.transform(F.sequence(F.lit(chunk), F.lit(FAN - 1), F.lit(chunk)), lambda i: F.get(cuts, i - 1))
    whole = F.size(F.filter(ends, is_below)) * chunk
    return whole + F.size(F.filter(F.slice(cuts, whole + 1, F.lit(chunk)), is_below))


def value_ranges(values: DataFrame, group: str, value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``_range``, a long that grows with ``value`` inside ``group``; no range has more than ``rows`` rows.

    ``values`` has one row per (group, value).  A quantile sketch of each range
    that is too large cuts it into up to ``FAN``, as often as its rows call for, so
    the number of ranges follows the number of rows and a task's share stays the
    same.  Sketches merge on the map side.  Their cuts may differ from run to run,
    so each level's are written once; a group that is small enough has none.
    """
    quantiles = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
    ranged, level = values.withColumn("_range", F.lit(0).cast("long")), 0
    while (ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) > rows:
        sketched = ranged.groupBy(group, "_range").agg(
            F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH).alias("_sketch")
        )
        cuts = sketched.filter(F.col("_n") > rows).select(
            group, "_range", F.least(F.ceil(2 * F.col("_n") / F.lit(rows)), F.lit(FAN)).alias("_parts"),
            F.kll_sketch_get_quantile_double("_sketch", quantiles).alias("_q"),
        )
        # Of FAN - 1 quantiles those are kept that part the range into as many as it needs, in even steps.
        picked = F.transform("_q", lambda q, i: F.when(F.floor((i + 1) * F.col("_parts") / F.lit(FAN)) > F.floor(i * F.col("_parts") / F.lit(FAN)), q))
        cuts = stage(cuts.select(group, "_range", F.array_compact(picked).alias("_cuts")), "rank-cuts")
        # First one row for each language asked for, then up to FAN of 2 KB: broadcast, so no task gets a whole language.
        small = F.broadcast(cuts) if level < 2 else cuts
        child = F.coalesce(_below("_cuts", value), F.lit(0))
        ranged = ranged.join(small, [group, "_range"], "left").withColumn("_range", F.col("_range") * FAN + child).select(*values.columns, "_range")
        level += 1
    return ranged


def average_ranks(values: DataFrame, group: str, value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Average rank of each distinct value per group, ties sharing theirs.

    ``values`` has one row per (group, value) with its count ``n``.  Values are
    ranked inside bounded ranges (``value_ranges``), ranges by a running sum of
    their counts; ranks are exact for any ranges.
    """
    ranged = value_ranges(values, group, value, rows)
    ahead = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        ranged.groupBy(group, "_range")
        .agg(F.sum("n").alias("_n"))
        .select(group, "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy(group, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return ranged.join(sizes, [group, "_range"]).select(
        group, value, "n", (below + (F.col("n") + 1) / 2).cast("double").alias("rank")
    )


def spearman(scored: DataFrame, group: str = "lang", x: str = "sim", y: str = "label") -> DataFrame:
    """Spearman correlation with average ranks: ``(group, n, spearman, low_sample)``.

    Null below three pairs and where one side is constant.  Equal pairs are
    collapsed to counts and written once; everything after reads that narrow
    table.  Ranks are joined back by value with hot values salted.
    """
    cells = stage(scored.groupBy(group, x, y).agg(F.count(F.lit(1)).alias("c")), "rank-cells")
    ranked = cells
    for value, out in ((x, "_rx"), (y, "_ry")):
        key = F.concat_ws("|", group, F.col(value).cast("string"))
        values = cells.groupBy(group, value).agg(F.sum("c").alias("n"))
        ranks = average_ranks(values, group, value).select(key.alias("_key"), F.col("rank").alias(out))
        hot = hot_keys_of(cells.select(key.alias("_key")), "_key")
        joined = skew_join(ranked.withColumn("_key", key), ranks, "_key", "inner", [x, y], hot)
        ranked = joined.drop("_key")
    total = cells.groupBy(group).agg(F.sum("c").alias("_total"))
    centre = (F.col("_total") + 1) / 2
    dx, dy, c = F.col("_rx") - centre, F.col("_ry") - centre, F.col("c")
    # One row per language asked for: broadcast, so no task gets a whole language.
    moments = (
        ranked.join(F.broadcast(total), group)
        .groupBy(group)
        .agg(
            F.sum("c").alias("n"),
            F.sum(c * dx * dy).alias("_xy"),
            F.sum(c * dx * dx).alias("_xx"),
            F.sum(c * dy * dy).alias("_yy"),
        )
    )
    rho = F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy"))
    return moments.select(
        group,
        "n",
        F.when(F.col("n") >= K.MIN_CORRELATION_PAIRS, rho).alias("spearman"),
        (F.col("n") < K.LOW_SAMPLE_PAIRS).alias("low_sample"),
    )


def sts_report(scored: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Spearman for every language asked for; one without pairs counts 0."""
    spark = scored.sparkSession
    asked = spark.createDataFrame([(p,) for p in languages], "lang string")
    return asked.join(spearman(scored), "lang", "left").select(
        "lang",
        F.coalesce("n", F.lit(0)).alias("n"),
        "spearman",
        F.coalesce("low_sample", F.lit(True)).alias("low_sample"),
    )


def _retrieval_usable(examples: DataFrame) -> DataFrame:
    return examples.filter(
        (F.col("task") == "retrieval")
        & F.array_contains("roles", "query")
        & F.array_contains("roles", "positive")
    )


def retrieval_available(examples: DataFrame) -> Column:
    """Scalar: how many examples could be evaluated."""
    return _retrieval_usable(examples).agg(F.count(F.lit(1)).alias("n")).scalar()


def retrieval_set(
    examples: DataFrame, limit: int | None = None, prompts: Prompts | None = None
) -> DataFrame:
    """Retrieval examples with a query and a positive, numbered ``i`` in example order.

    ``limit`` keeps the first ones (a bounded top-n); left out, all are evaluated and
    numbered inside bounded buckets.
    """
    prompts = prompts or Prompts()
    at = lambda c, role: F.get(F.col(c), F.array_position("roles", role).cast("int") - 1)
    picked = _retrieval_usable(examples).select(
        *ORDER_KEY,
        "lang",
        at("text_ids", "query").alias("q_id"),
        at("text_ids", "positive").alias("p_id"),
        prompts.student_text(F.lit("ret"), at("texts", "query")).alias("q_text"),
        prompts.student_text(F.lit("document"), at("texts", "positive")).alias("p_text"),
    )
    if limit is None:
        return example_position(picked, out="i")
    top = picked.orderBy(*ORDER_KEY).limit(limit)
    # ``top`` holds at most ``limit`` rows, so numbering them in one window is bounded by it.
    return top.select("*", (F.row_number().over(W.orderBy(*ORDER_KEY)) - 1).cast("long").alias("i"))


def retrieval_vectors(chosen: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``(i, lang, q_vec, p_vec)``: query vectors for queries, document vectors for passages.

    The set is a bounded top-n, so no key can be hot.
    """
    side = lambda i, c: F.struct(F.lit(i).alias("side"), F.col(c).alias("text_id"))
    refs = chosen.select("i", "lang", F.explode(F.array(side(0, "q_id"), side(1, "p_id"))).alias("_r"))
    refs = refs.select("i", "lang", "_r.side", "_r.text_id", (F.col("_r.side") == 0).alias("is_q"))
    found = attach_vectors(refs, {"vec": (embeddings, "is_q")}, ["i", "side"], hot={})
    on_side = lambda k: F.any_value(F.when(F.col("side") == k, F.col("vec")), F.lit(True))
    return (
        found.groupBy("i", "lang")
        .agg(on_side(0).alias("q_vec"), on_side(1).alias("p_vec"))
        .filter(F.col("q_vec").isNotNull() & F.col("p_vec").isNotNull())
    )


def _nearest(pivots: np.ndarray) -> Callable[..., Column]:
    """Column function: number of the nearest pivot."""

    def find(vectors: pa.Array) -> pa.Array:
        points = to_matrix(vectors)
        return pa.array(np.argmin((pivots**2).sum(1) - 2 * points @ pivots.T, axis=1).astype(np.int32) if len(points) else np.zeros(0, np.int32))

    return F.arrow_udf(find, "int")


def _in_blocks(vectors: DataFrame, block: int) -> DataFrame:
    """Passages with ``block``, a number shared by at most ``block`` passages that lie near one another.

    Passages go to the nearest of a few pivots, a bounded sample by hash, and are
    dealt inside it; the blocks only decide what can be skipped, never a rank.
    """
    chosen = vectors.orderBy(F.xxhash64("i")).limit(PIVOTS).select("p_vec").toArrow()
    near = _nearest(to_matrix(chosen["p_vec"]))
    rows = vectors.select(F.col("i").alias("j"), F.col("p_vec").alias("vec"), near("p_vec").alias("_pivot"))
    placed = dense_position(rows, [F.floor(F.col("j") / F.lit(BUCKET_ROWS))], ["j"], within=["_pivot"], out="_at")
    return placed.select("j", "vec", (F.floor(F.col("_at") / F.lit(block)) * PIVOTS + F.col("_pivot")).alias("block"))


def _balls(blocks: DataFrame) -> pa.Table:
    """Centre and radius of every block; at most ``BALL_BYTES`` reach the driver."""

    def ball(table: pa.Table) -> pa.Table:
        points = to_matrix(table.column("vec"))
        centre = points.mean(0)
        radius = np.sqrt(((points - centre) ** 2).sum(1)).max()
        return pa.table({"block": table.column("block").slice(0, 1), "centre": pa.array([centre.tolist()]), "radius": pa.array([radius])})

    return blocks.groupBy("block").applyInArrow(ball, "block long, centre array<double>, radius double").toArrow()


def own_ranks(vectors: DataFrame, block: int = BLOCK, digits: int = 12) -> DataFrame:
    """Rank of each query's own passage by descending score: ``(i, rank, n_blocks, n_scored)``.

    Passages are cut into blocks of near ones.  No passage of a block scores more
    than the block's centre does plus its radius times the query's length, so a
    query is scored only against blocks that may hold a better one; ranks stay
    exact.  ``n_scored`` of ``n_blocks`` were scored.  Query groups meet blocks by
    equality on both numbers; a task multiplies two blocks and returns one count per
    query.  Scores are rounded to ``digits``, so that the order of a sum decides
    nothing; ties go to the smaller index.
    """
    vectors = stage(vectors.select(F.col("i").cast("long").alias("i"), "q_vec", "p_vec"), "retrieval")
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("p_vec"))).first()
    # Larger blocks where the centres would grow beyond what a driver takes.
    block = max(block, -(-(n or 0) * (dim or 0) * 8 // BALL_BYTES))
    blocks = stage(_in_blocks(vectors, block), "retrieval-blocks")
    balls = _balls(blocks)
    shared = vectors.sparkSession.sparkContext.broadcast((balls["block"].to_numpy(), to_matrix(balls["centre"]), balls["radius"].to_numpy()))
    # Sums in another order and rounding to digits may move a score by this much.
    slack = 10.0**-digits + 1e-9

    def reach(queries: pa.Array, own: pa.Array) -> pa.Array:
        numbers, centres, radii = shared.value
        points = to_matrix(queries)
        if not len(points):
            return pa.array([], pa.list_(pa.int64()))
        most = points @ centres.T + np.sqrt((points**2).sum(1))[:, None] * radii[None, :]
        which, at = np.nonzero(most >= np.asarray(own)[:, None] - slack)
        offsets = np.searchsorted(which, np.arange(len(points) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[at]))

    own = row_dot("q_vec", "p_vec")
    asked = vectors.select("i", F.col("q_vec").alias("vec"), own.alias("own"), F.floor(F.col("i") / F.lit(block)).alias("part"))
    asked = asked.withColumn("to", F.arrow_udf(reach, "array<long>")("vec", "own"))
    queries = asked.select("i", "vec", "own", "part", F.explode("to").alias("block"))
    # Each block goes to the query groups that ask for it.
    wanted = queries.select("block", "part").distinct()
    passages = blocks.join(wanted, "block").select("j", "vec", F.col("part").alias("to_part"), F.col("block").alias("of_block"))

    def ahead(left: pa.Table, right: pa.Table) -> pa.Table:
        i = left.column("i").to_numpy()
        if not left.num_rows or not right.num_rows:
            return pa.table({"i": pa.array(i, pa.int64()), "ahead": pa.array([0] * len(i), pa.int64())})
        j = right.column("j").to_numpy()
        score = np.round(to_matrix(left.column("vec")) @ to_matrix(right.column("vec")).T, digits)
        mine = np.round(left.column("own").to_numpy(), digits)[:, None]
        other = j[None, :] != i[:, None]
        # The own passage is compared with itself through "other", not through rounding.
        better = other & ((score > mine) | ((score == mine) & (j[None, :] < i[:, None])))
        return pa.table({"i": pa.array(i, pa.int64()), "ahead": pa.array(better.sum(1), pa.int64())})

    counts = queries.groupBy("part", "block").cogroup(passages.groupBy("to_part", "of_block"))
    # A query's own passage lies in a block that it reaches, so no query is left out.
    return (
        counts.applyInArrow(ahead, "i long, ahead long")
        .groupBy("i")
        .agg((F.sum("ahead") + 1).alias("rank"), F.lit(len(balls)).cast("long").alias("n_blocks"), F.count(F.lit(1)).alias("n_scored"))
    )


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """One row: ``n``, ``recall_at_1`` and ``mrr``; metrics are null below two queries."""
    enough = F.col("n") >= 2
    return ranks.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("rank") == 1).cast("double")).alias("_hit"),
        F.avg(F.lit(1.0) / F.col("rank")).alias("_rr"),
    ).select(
        "n", F.when(enough, F.col("_hit")).alias("recall_at_1"), F.when(enough, F.col("_rr")).alias("mrr")
    )


def lang_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang")


def eval_report(
    sts: DataFrame, retrieval: DataFrame, by_lang: DataFrame, model: str, fallback: bool | Column = False, available: Column | None = None
) -> DataFrame:
    """One nested row: model, correlation per language, retrieval metrics with counts per language.

    ``available`` is the number of examples that could be evaluated, beside ``n`` that were.

    Every input is already an aggregate with one row, or one row per language.
    """
    flag = fallback if isinstance(fallback, Column) else F.lit(fallback)
    per_lang = sts.agg(
        F.sort_array(F.collect_list(F.struct("lang", "n", "spearman", "low_sample"))).alias("v")
    ).scalar()
    counts = by_lang.agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("v")).scalar()
    return retrieval.select(
        F.lit(model).alias("model"),
        flag.alias("fallback"),
        per_lang.alias("sts"),
        F.struct("n", (F.col("n") if available is None else available).alias("available"), "recall_at_1", "mrr", counts.alias("by_lang")).alias("retrieval"),
    )
