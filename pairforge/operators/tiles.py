"""Pairwise work over pairs of tiles: a step may be larger than one task.

Rows are numbered inside their group and cut into tiles of ``tile_rows``.  Every
tile meets every tile of its group by equality on both tile numbers; a task holds
two tiles and their matrix product and returns a few sums for each of its rows.
Those merge: sums of exponentials are kept relative to their largest exponent, so
any number of tiles gives the same result.  Pairs themselves are never emitted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.functions.vectors import to_matrix, unit_rows

# Rows of a tile: a matrix of 2,048 x 2,048 doubles takes 32 MB.
TILE_ROWS = 2048


def tile_pairs(rows: DataFrame, columns: DataFrame, n_rows: int, tile_rows: int, work: Callable, schema: str) -> DataFrame:
    """``work(rows, columns)`` for every pair of tiles that both have rows.

    Both frames have ``step`` and ``place`` (below ``n_rows``), and what ``work``
    needs; columns may carry pairs with ``to``, which go to the tiles of both.
    """
    last = -(-n_rows // tile_rows) - 1
    tile = lambda c: F.floor(F.col(c) / F.lit(tile_rows)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(last)))
    left = rows.select("*", tile("place").alias("_r"), every.alias("_c"))
    pairs = columns.filter("to IS NOT NULL").select("*", tile("place").alias("_tr"), tile("to").alias("_tc"))
    right = columns.filter("to IS NULL").select("*", every.alias("_tr"), tile("place").alias("_tc")).unionByName(pairs)
    # Both sides may come from one frame; a cogroup needs columns of their own.
    right = right.select(F.col("step").alias("_step"), *[F.col(c).alias(c) for c in right.columns if c != "step"])
    return left.groupBy("step", "_r", "_c").cogroup(right.groupBy("_step", "_tr", "_tc")).applyInArrow(work, schema)


def _logsum(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each row (minus infinity if it has none), exponentials relative to it."""
    top = values.max(1)
    with np.errstate(invalid="ignore"):
        return top, np.where(np.isneginf(values), 0.0, np.exp(values - top[:, None]))


# Sums that a tile gives for each of its rows: largest exponents (``_top``) and sums relative to them, and plain sums.
ROW_SUMS = ("t_top", "t_sum", "t_teacher", "t_student", "s_top", "s_sum", "n_top", "n_weight", "n_sum", "d_sum")


def loss_sums(settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Tile function of the losses: one row of sums for each row of the tile, one value for each pair in it."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        is_pair = np.asarray(right["to"].is_valid())
        points, pairs = right.filter(pa.array(~is_pair)), right.filter(pa.array(is_pair))
        if not len(left) or not len(points):
            return LOSS_ARROW.empty_table()
        left, points = left.sort_by("place"), points.sort_by("place")
        row, column = left["place"].to_numpy(), points["place"].to_numpy()
        student = unit_rows(to_matrix(left["s_vec"])) @ unit_rows(to_matrix(points["s_vec"])).T
        teacher = unit_rows(to_matrix(left["t_vec"])) @ unit_rows(to_matrix(points["t_vec"])).T
        self_ = row[:, None] == column[None, :]
        tau = settings.temperature

        t_top, weight = _logsum(np.where(self_, -np.inf, teacher / tau))
        s_logits = np.where(self_, -np.inf, student / tau)
        s_top, s_exp = _logsum(s_logits)
        sums = {"t_top": t_top, "t_sum": weight.sum(1), "t_teacher": (weight * teacher).sum(1), "t_student": (weight * student).sum(1)}
        sums |= {"s_top": s_top, "s_sum": s_exp.sum(1)}

        i, j = pairs["place"].to_numpy(), pairs["to"].to_numpy()
        a, b = np.searchsorted(row, i), np.searchsorted(column, j)
        found = (a < len(row)) & (b < len(column)) & (i != j)
        found[found] &= (row[a[found]] == i[found]) & (column[b[found]] == j[found])
        kind, rank = np.asarray(pairs["kind"].to_pylist(), object), pairs["rank"].to_numpy()
        positive, graded = found & (kind == "positive"), found & (kind == "graded")
        a_pos, b_pos = np.divmod(np.unique(a[positive] * len(column) + b[positive]), len(column))

        s_logits[a_pos, b_pos] = -np.inf
        n_top, n_exp = _logsum(s_logits)
        negative = np.where(np.isneginf(s_logits), 0.0, np.clip((teacher + 1) / 2, 0, 1) ** settings.gamma)
        sums |= {"n_top": n_top, "n_weight": negative.sum(1), "n_sum": (negative * n_exp).sum(1)}
        sums["d_sum"] = np.where(self_, 0.0, np.exp(settings.disperse_t * student)).sum(1)

        gap = (student - teacher)[a[graded], b[graded]] ** 2
        values = np.concatenate([student[a_pos, b_pos] / tau, gap])
        n, m = len(row), len(values)
        step = left["step"][0].as_py()
        out = {
            "step": pa.array([step] * (n + m), pa.int64()),
            "place": pa.array(np.concatenate([row, row[a_pos], i[graded]]), pa.int64()),
            "rank": pa.array(np.concatenate([np.full(n + len(a_pos), -1), rank[graded]]), pa.int32()),
            "kind": pa.array(["row"] * n + ["positive"] * len(a_pos) + ["graded"] * len(gap)),
            "value": pa.array(np.concatenate([np.zeros(n), values])),
        }
        # A tile whose only column is the row itself has nothing for it: an exponent of minus infinity and sums of zero.
        for name in ROW_SUMS:
            out[name] = pa.array(np.concatenate([sums[name], np.zeros(m)]))
        return pa.table(out, LOSS_ARROW)

    return work


LOSS_SUMS = "step long, place long, rank int, kind string, value double, " + ", ".join(f"{c} double" for c in ROW_SUMS)
LOSS_ARROW = pa.schema(
    [("step", pa.int64()), ("place", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("value", pa.float64())]
    + [(c, pa.float64()) for c in ROW_SUMS]
)


def _relative(top: str, *sums: str) -> list[Column]:
    """The merged exponent of a row's tiles, and its sums relative to that."""
    most = F.array_max(F.transform("_tiles", lambda t: t[top]))
    none = F.lit(float("-inf"))
    out = [most.alias(top)]
    for name in sums:
        part = lambda t, name=name: F.when(t[top] > none, t[name] * F.exp(t[top] - most)).otherwise(0.0)
        out.append(F.aggregate(F.transform("_tiles", lambda t: part(t)), F.lit(0.0), lambda acc, x: acc + x).alias(name))
    return out


def merged_rows(sums: DataFrame) -> DataFrame:
    """One row per (step, place) from its tiles' sums; a row has as many as there are tiles beside it."""
    tiles = sums.filter("kind = 'row'").groupBy("step", "place").agg(F.collect_list(F.struct(*ROW_SUMS)).alias("_tiles"))
    plain = lambda c: F.aggregate(F.transform("_tiles", lambda t: t[c]), F.lit(0.0), lambda acc, x: acc + x).alias(c)
    return tiles.select(
        "step", "place",
        *_relative("t_top", "t_sum", "t_teacher", "t_student"), *_relative("s_top", "s_sum"),
        *_relative("n_top", "n_sum"), plain("n_weight"), plain("d_sum"),
    )


def _cosines(left: pa.Table, right: pa.Table, nearest: int) -> pa.Table:
    if not len(left) or not len(right):
        return COSINE_ARROW.empty_table()
    right = right.sort_by("place")
    row, column = left["place"].to_numpy(), right["place"].to_numpy()
    cosine = unit_rows(to_matrix(left["vec"])) @ unit_rows(to_matrix(right["vec"])).T
    others = np.where(row[:, None] == column[None, :], -np.inf, cosine)
    # Best first, ties to the smaller place.
    best = np.argsort(-others, axis=1, kind="stable")[:, :nearest]
    near = [
        [{"cosine": float(others[k, b]), "place": int(column[b])} for b in best[k] if others[k, b] > -np.inf] for k in range(len(row))
    ]
    return pa.table(
        {
            "step": pa.array(left["step"].to_pylist(), pa.int64()), "place": pa.array(row, pa.int64()),
            "n": pa.array(np.full(len(row), len(column)), pa.int64()), "total": pa.array(cosine.sum(1)),
            "lowest": pa.array(cosine.min(1)), "highest": pa.array(others.max(1)),
            "near": pa.array(near, COSINE_ARROW.field("near").type),
        },
        COSINE_ARROW,
    )


COSINE_SUMS = "step long, place long, n long, total double, lowest double, highest double, near array<struct<cosine: double, place: long>>"
COSINE_ARROW = pa.schema(
    [("step", pa.int64()), ("place", pa.int64()), ("n", pa.int64())]
    + [(c, pa.float64()) for c in ("total", "lowest", "highest")]
    + [("near", pa.list_(pa.struct([("cosine", pa.float64()), ("place", pa.int64())])))]
)


def cosine_rows(points: DataFrame, n_rows: int, nearest: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """For each row of the cosine matrix of its step: ``n, total, lowest`` over all columns, ``highest`` and the
    ``nearest`` over the others.  ``points``: step, place, vec."""
    columns = points.withColumn("to", F.lit(None).cast("long"))
    parts = tile_pairs(points, columns, n_rows, tile_rows, lambda left, right: _cosines(left, right, nearest), COSINE_SUMS)
    # As many lists as tiles, of ``nearest`` each.
    order = lambda a, b: F.when(a.cosine > b.cosine, -1).when(a.cosine < b.cosine, 1).otherwise(F.signum(a.place - b.place).cast("int"))
    merged = parts.groupBy("step", "place").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.flatten(F.collect_list("near")).alias("near"),
    )
    alone = F.when(F.col("highest") > float("-inf"), F.col("highest"))
    return merged.withColumns({"highest": alone, "near": F.slice(F.array_sort("near", order), 1, nearest)})
