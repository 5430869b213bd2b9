"""Pairwise alignment metrics per global batch.

All pairs of a batch of up to ``tile_rows`` rows are one matrix product inside a
task; a larger batch is cut into tiles whose row sums merge (``tiles``).  Pair
rows are never emitted.  A step has at most ``world * max_texts`` rows: texts
beyond ``max_texts`` of a rank are no part of the batch, as its definition says,
and are counted (``n_cut``); a rank outside the world is an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pairforge import constants as K
from pairforge.functions.vectors import to_matrix, unit_rows
from pairforge.operators import tiles
from pairforge.session import stage

PARTS = ("kl", "focal", "disperse", "sts")


@dataclass(frozen=True)
class LossSettings:
    lambda_kl: float = K.LAMBDA_KL
    lambda_focal: float = K.LAMBDA_FOCAL
    lambda_disperse: float = K.LAMBDA_DISPERSE
    lambda_sts: float = K.LAMBDA_STS
    temperature: float = K.TEMPERATURE
    gamma: float = K.FOCAL_GAMMA
    disperse_t: float = K.DISPERSE_T

    @classmethod
    def from_config(cls, config: dict) -> "LossSettings":
        loss = config.get("loss") or {}
        names = {
            "lambda_kl": "lambda_kl",
            "lambda_focal": "lambda_focal",
            "lambda_disperse": "lambda_disp",
            "lambda_sts": "lambda_sts",
            "temperature": "temperature",
            "gamma": "focal_gamma",
            "disperse_t": "disperse_t",
        }
        return cls(**{ours: float(loss[key]) for ours, key in names.items() if key in loss})


def _scaled(cosines: np.ndarray, tau: float) -> np.ndarray:
    """Logits without the diagonal."""
    logits = cosines / tau
    np.fill_diagonal(logits, -np.inf)
    return logits


def _log_sum(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials relative to the row maximum, row maximum, log of the row's sum)."""
    top = logits.max(1)
    relative = np.exp(logits - top[:, None])
    return relative, top, np.log(relative.sum(1)) + top


def _softmax_gap(student: np.ndarray, teacher: np.ndarray, tau: float) -> float:
    """Mean row-wise KL from the student's to the teacher's neighbourhood distribution."""
    if len(student) < 2:
        return 0.0
    weight, _, t_log = _log_sum(_scaled(teacher, tau))
    _, _, s_log = _log_sum(_scaled(student, tau))
    # The diagonal has weight zero, so the plain cosines can be averaged.
    difference = np.einsum("ij,ij->i", weight, teacher) - np.einsum("ij,ij->i", weight, student)
    return float((difference / tau / weight.sum(1) + s_log - t_log).mean())


def _focal(
    student: np.ndarray,
    teacher: np.ndarray,
    anchor: np.ndarray,
    other: np.ndarray,
    tau: float,
    gamma: float,
) -> float:
    """InfoNCE whose negatives are weighted by teacher similarity; mean over positive pairs.

    ``anchor`` and ``other`` are the distinct positive pairs off the diagonal.
    """
    if len(student) < 2 or not len(anchor):
        return 0.0
    own = student[anchor, other] / tau
    logits = _scaled(student, tau)
    logits[anchor, other] = -np.inf
    top = logits.max(1)
    usable = np.isfinite(top[anchor])
    anchor, other, own = anchor[usable], other[usable], own[usable]
    if not len(anchor):
        return 0.0
    rows = np.unique(anchor)
    weight = np.clip((teacher[rows] + 1.0) / 2.0, 0.0, 1.0) ** gamma
    weight[np.isneginf(logits[rows])] = 0.0
    # Sum of weighted negatives relative to the anchor's own top, rescaled per positive.
    spread = np.einsum("ij,ij->i", weight, np.exp(logits[rows] - top[rows, None]))
    spread /= weight.sum(1) + K.LOSS_EPS
    peak = np.maximum(own, top[anchor])
    hit = np.exp(own - peak)
    miss = spread[np.searchsorted(rows, anchor)] * np.exp(top[anchor] - peak)
    return float(-np.log(hit / (hit + miss + K.LOSS_EPS)).mean())


def _disperse(student: np.ndarray, t: float) -> float:
    n = len(student)
    if n < 2:
        return 0.0
    powers = np.exp(t * student)
    np.fill_diagonal(powers, 0.0)
    return float(np.log(powers.sum() / (n * (n - 1)) + K.LOSS_EPS))


def _pair_gap(student: np.ndarray, teacher: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
    keep = i != j
    if not keep.any():
        return 0.0
    gap = student[i[keep], j[keep]] - teacher[i[keep], j[keep]]
    return float((gap * gap).mean())


def _bounded(df: DataFrame, world: int, max_texts: int, *indices: str) -> DataFrame:
    """Rows whose indices lie inside the batch (truncation to its fixed size); a rank outside the world is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"rank outside 0..{world - 1}: "), F.coalesce(F.col("rank").cast("string"), F.lit("null"))))
    ok = F.when((F.col("rank") >= 0) & (F.col("rank") < world), F.lit(True)).otherwise(wrong.cast("boolean"))
    for name in indices:
        ok = ok & (F.col(name) >= 0) & (F.col(name) < max_texts)
    return df.filter(ok)


def batch_losses(
    vectors: DataFrame,
    positives: DataFrame,
    graded: DataFrame,
    *,
    world: int,
    max_texts: int,
    settings: LossSettings = LossSettings(),
    parts: Sequence[str] = PARTS,
    tile_rows: int = tiles.TILE_ROWS,
) -> DataFrame:
    """Loss parts per ``(step, rank)``.

    ``vectors``: step, rank, local_idx, s_vec, t_vec and optionally ``valid``;
    ``positives`` and ``graded``: step, rank, i, j.  The matrix losses see the
    whole step (all ranks, positives inside their own rank); the graded-pair
    loss of a rank sees that rank's pairs only.  Parts not asked for are 0.  Each
    rank keeps its texts below ``max_texts`` (the batch's fixed size); ``cut_points``
    counts the others.  A batch above ``tile_rows`` is worked on in pairs of tiles.
    """
    valid = F.coalesce("valid", F.lit(False)) if "valid" in vectors.columns else F.lit(True)
    rows = _bounded(vectors, world, max_texts, "local_idx").filter(valid)
    points = rows.select(
        "step", F.col("rank").cast("int"), F.col("local_idx").cast("int"), "s_vec", "t_vec"
    )
    tagged = [
        _bounded(pairs, world, max_texts, "i", "j").select(
            F.col("step").alias("pair_step"),
            F.col("rank").cast("int"),
            F.col("i").cast("int"),
            F.col("j").cast("int"),
            F.lit(kind).alias("kind"),
        )
        for kind, pairs, wanted in (
            ("positive", positives, "focal" in parts),
            ("graded", graded, "sts" in parts),
        )
        if wanted
    ]
    wanted = frozenset(parts)
    if world * max_texts > tile_rows:
        return _tiled_losses(points, tagged, world, max_texts, settings, wanted, tile_rows)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        rank = left.column("rank").to_numpy()
        place = rank.astype(np.int64) * max_texts + left.column("local_idx").to_numpy()
        order = np.argsort(place)
        rank, place = rank[order], place[order]
        ranks = np.unique(rank)
        if not n:
            return pa.table({name: [] for name in RESULT_NAMES}, RESULT_ARROW)
        student = unit_rows(to_matrix(left.column("s_vec")))[order]
        teacher = unit_rows(to_matrix(left.column("t_vec")))[order]
        cos_s, cos_t = student @ student.T, teacher @ teacher.T

        pair_rank = right.column("rank").to_numpy().astype(np.int64)
        i = np.searchsorted(place, pair_rank * max_texts + right.column("i").to_numpy())
        j = np.searchsorted(place, pair_rank * max_texts + right.column("j").to_numpy())
        found = (i < n) & (j < n)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        found &= (place[i] == pair_rank * max_texts + right.column("i").to_numpy()) & (
            place[j] == pair_rank * max_texts + right.column("j").to_numpy()
        )
        kind = right.column("kind").to_numpy(zero_copy_only=False)
        is_pos, is_graded = found & (kind == "positive") & (i != j), found & (kind == "graded")

        kl = _softmax_gap(cos_s, cos_t, settings.temperature) if "kl" in wanted else 0.0
        disperse = _disperse(cos_s, settings.disperse_t) if "disperse" in wanted else 0.0
        focal = 0.0
        if "focal" in wanted:
            anchor, other = np.divmod(np.unique(i[is_pos] * n + j[is_pos]), n)
            focal = _focal(cos_s, cos_t, anchor, other, settings.temperature, settings.gamma)
        sts = [
            _pair_gap(cos_s, cos_t, i[is_graded & (pair_rank == r)], j[is_graded & (pair_rank == r)])
            for r in ranks
        ]
        step = left.column("step")[0].as_py()
        total = [
            settings.lambda_kl * kl
            + settings.lambda_focal * focal
            + settings.lambda_disperse * disperse
            + settings.lambda_sts * g
            for g in sts
        ]
        k = len(ranks)
        columns = [[step] * k, ranks.tolist(), [kl] * k, [focal] * k, [disperse] * k, sts, total]
        columns += [[world * max_texts] * k, [n] * k]
        return pa.table(dict(zip(RESULT_NAMES, columns)), RESULT_ARROW)

    by_step = points.groupBy("step")
    if not tagged:
        return by_step.applyInArrow(lambda table: score(table, NO_PAIRS), RESULT)
    pairs = tagged[0] if len(tagged) == 1 else tagged[0].unionByName(tagged[1])
    return by_step.cogroup(pairs.groupBy("pair_step")).applyInArrow(score, RESULT)


def _tiled_losses(
    points: DataFrame, tagged: Sequence[DataFrame], world: int, max_texts: int, settings: LossSettings, wanted: frozenset, tile_rows: int
) -> DataFrame:
    """The same losses from sums over pairs of tiles, merged row by row and then per step."""
    place = lambda c: (F.col("rank").cast("long") * max_texts + F.col(c)).alias
    rows = points.select("step", place("local_idx")("place"), "s_vec", "t_vec")
    none = lambda kind: F.lit(None).cast(kind)
    columns = rows.withColumns({"to": none("long"), "kind": none("string"), "rank": none("int")})
    for pairs in tagged:
        ends = pairs.select(F.col("pair_step").alias("step"), place("i")("place"), place("j")("to"), "kind", "rank")
        columns = columns.unionByName(ends, allowMissingColumns=True)
    sums = stage(tiles.tile_pairs(rows, columns, world * max_texts, tile_rows, tiles.loss_sums(settings), tiles.LOSS_SUMS), "tile-sums")

    merged = tiles.merged_rows(sums)
    tau, eps = settings.temperature, K.LOSS_EPS
    row_kl = (
        (F.col("t_teacher") - F.col("t_student")) / tau / F.col("t_sum")
        + F.ln("s_sum") + F.col("s_top") - F.ln("t_sum") - F.col("t_top")
    )
    per_step = merged.filter("t_sum > 0").groupBy("step").agg(F.avg(row_kl).alias("kl"), F.sum("d_sum").alias("d_sum"))
    # Each positive pair lies in one tile and meets the merged negatives of its anchor.  The logarithm of zero is null here.
    own = sums.filter("kind = 'positive'").select("step", "place", F.col("value").alias("own"))
    usable = own.join(merged.filter(F.col("n_top") > float("-inf")), ["step", "place"])
    peak = F.greatest("own", "n_top")
    hit = F.exp(F.col("own") - peak)
    miss = F.col("n_sum") / (F.col("n_weight") + eps) * F.exp(F.col("n_top") - peak)
    focal = usable.groupBy("step").agg(F.avg(F.coalesce(-F.ln(hit / (hit + miss + eps)), F.lit(math.inf))).alias("focal"))
    sts = sums.filter("kind = 'graded'").groupBy("step", "rank").agg(F.avg("value").alias("sts"))

    # One row per step and rank.
    ranks = points.groupBy("step", "rank").agg(F.count(F.lit(1)).alias("_n"))
    n_valid = F.sum("_n").over(W.partitionBy("step"))
    all_of = ranks.withColumn("n_valid", n_valid).join(per_step, "step", "left").join(focal, "step", "left").join(sts, ["step", "rank"], "left")
    zero = F.lit(0.0)
    n = F.col("n_valid").cast("double")
    part = {
        "loss_kl": F.coalesce("kl", zero) if "kl" in wanted else zero,
        "loss_focal": F.coalesce("focal", zero) if "focal" in wanted else zero,
        "loss_disp": F.when(n >= 2, F.ln(F.coalesce("d_sum", zero) / F.greatest(n * (n - 1), F.lit(1.0)) + eps)).otherwise(zero) if "disperse" in wanted else zero,
        "loss_sts": F.coalesce("sts", zero) if "sts" in wanted else zero,
    }
    weights = {"loss_kl": settings.lambda_kl, "loss_focal": settings.lambda_focal, "loss_disp": settings.lambda_disperse, "loss_sts": settings.lambda_sts}
    total = sum((part[c] * w for c, w in weights.items()), zero)
    return all_of.select(F.col("step").cast("long").alias("step"), "rank", *[c.alias(k) for k, c in part.items()], total.alias("loss"), F.lit(world * max_texts).cast("long").alias("n"), "n_valid")


def cut_points(vectors: DataFrame, max_texts: int) -> DataFrame:
    """``step, rank, n_cut``: valid rows beyond the batch's fixed size, where there are any."""
    valid = F.coalesce("valid", F.lit(False)) if "valid" in vectors.columns else F.lit(True)
    beyond = vectors.filter(valid & ((F.col("local_idx") < 0) | (F.col("local_idx") >= max_texts)))
    return beyond.groupBy("step", "rank").agg(F.count(F.lit(1)).alias("n_cut"))


NO_PAIRS = pa.table(
    {
        "rank": pa.array([], pa.int32()),
        "i": pa.array([], pa.int32()),
        "j": pa.array([], pa.int32()),
        "kind": pa.array([], pa.string()),
    }
)
RESULT = (
    "step long, rank int, loss_kl double, loss_focal double, loss_disp double, "
    "loss_sts double, loss double, n long, n_valid long"
)
RESULT_ARROW = pa.schema(
    [
        ("step", pa.int64()),
        ("rank", pa.int32()),
        *[(c, pa.float64()) for c in ("loss_kl", "loss_focal", "loss_disp", "loss_sts", "loss")],
        ("n", pa.int64()),
        ("n_valid", pa.int64()),
    ]
)
RESULT_NAMES = RESULT_ARROW.names


def step_report(losses: DataFrame, every: int = K.DEFAULT_LOG_EVERY, rank: int = 0) -> DataFrame:
    """The reporting rank's losses of every ``every``-th step."""
    return losses.filter((F.col("rank") == rank) & (F.pmod("step", F.lit(every)) == 0)).drop("rank")


def pairwise_cosine(
    vectors: DataFrame, *, vec: str = "vec", group: str = "step", index: str = "idx", max_rows: int, nearest: int = 1, tile_rows: int = tiles.TILE_ROWS
) -> DataFrame:
    """The cosine matrix of each group, reduced row by row inside the tiles.

    One row per vector: ``n`` columns, their ``total`` and ``lowest`` cosine, and over
    the others the ``highest`` and the ``nearest`` (cosine and index, best first).
    ``index`` numbers the rows of a group below ``max_rows``; one beyond is an error.
    The matrix is never emitted, and a group may be larger than one task holds.
    """
    place = F.col(index).cast("long")
    beyond = F.raise_error(F.concat(F.lit(f"index exceeds 0..{max_rows - 1}: "), F.coalesce(place.cast("string"), F.lit("null")))).cast("long")
    points = vectors.select(
        F.col(group).cast("long").alias("step"), F.when((place >= 0) & (place < max_rows), place).otherwise(beyond).alias("place"), F.col(vec).alias("vec")
    )
    kinds = dict(vectors.dtypes)
    rows = tiles.cosine_rows(points, max_rows, nearest, tile_rows)
    return rows.select(F.col("step").cast(kinds[group]).alias(group), F.col("place").cast(kinds[index]).alias(index), "n", "total", "lowest", "highest", "near")
