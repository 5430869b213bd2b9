"""Dense global positions without a global sort or a one-task window.

The order key is cut into buckets that are monotone in the order and bounded in
size.  One narrow aggregation counts the buckets, a running sum over the
bucket counts (one row per bucket, not per data row) gives each bucket its
offset, and a window *inside* each bucket gives the rest.  The result depends
only on the data, so a recomputed task after a lost executor agrees with the
first run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairforge import constants as K
from pairforge.schemas import ORDER_KEY

# Rows of one source per bucket.  10^11 rows make about 760,000 bucket rows.
BUCKET_ROWS = 1 << 17

#: Bits of each part of a packed order value: 2,048 sources, 2 * 10^12 rows a source, 2,048 sides a row.
ORDER_BITS = {"source_seq": 11, "row_ord": 41, "side": 11}


def packed_order() -> Column:
    """The order (source_seq, row_ord, side) as one long that sorts alike.

    A value of fixed width can be the buffer of a hash aggregate, a struct
    cannot.  A part beyond its bits is an error, never a wrong order.
    """
    fits, value = F.lit(True), F.lit(0).cast("long")
    for name, bits in ORDER_BITS.items():
        fits = fits & (F.col(name) >= 0) & (F.col(name) < 1 << bits)
        value = F.shiftleft(value, bits).bitwiseOR(F.col(name).cast("long"))
    return F.when(fits, value).otherwise(F.raise_error(F.lit(f"an order part is null or beyond its bits: {ORDER_BITS}")).cast("long"))


def unpacked_order(value: str | Column) -> list[Column]:
    """source_seq, row_ord and side of a packed order value."""
    left, kinds, out = F.col(value) if isinstance(value, str) else value, {"row_ord": "long"}, []
    below = sum(ORDER_BITS.values())
    for name, bits in ORDER_BITS.items():
        below -= bits
        part = F.shiftright(left, below).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out.append(part.cast(kinds.get(name, "int")).alias(name))
    return out


def source_bucket() -> list[Column]:
    """Buckets for the (source_seq, row_ord) order; a big source is many buckets."""
    return [F.col("source_seq"), F.floor(F.col("row_ord") / F.lit(BUCKET_ROWS))]


def hash_bucket(hex_column: str, digits: int = 4) -> list[Column]:
    """Buckets for an order by a hex digest: its leading digits, evenly filled."""
    return [F.substring(hex_column, 1, digits)]


def bucket_offsets(df: DataFrame, buckets: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """One row per bucket: ``within``, ``_b*``, ``_before`` (rows ahead), ``_rows``, ``_total``."""
    names = [f"_b{i}" for i in range(len(buckets))]
    counts = (
        df.select(*within, *[b.alias(n) for b, n in zip(buckets, names)])
        .groupBy(*within, *names)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    group = W.partitionBy(*within)
    ahead = group.orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *within,
        *names,
        "_rows",
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("_total"),
    )


def dense_position(
    df: DataFrame,
    buckets: Sequence[Column],
    order: Sequence[str | Column],
    within: Sequence[str] = (),
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in the order, per ``within`` group.

    ``buckets`` must not decrease along ``order``.  ``total`` names an optional
    column for the size of the group.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    offsets = bucket_offsets(df, buckets, within)
    keyed = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    inside = W.partitionBy(*within, *names).orderBy(*order)
    numbered = keyed.withColumn("_rn", F.row_number().over(inside) - 1)
    placed = numbered.join(offsets, [*within, *names])
    extra = [F.col("_total").alias(total)] if total else []
    return placed.select(
        *df.columns, (F.col("_before") + F.col("_rn")).alias(out), *extra
    )


def example_position(df: DataFrame, out: str = "pos", total: str | None = None) -> DataFrame:
    """Position in (source_seq, row_ord) order."""
    return dense_position(df, source_bucket(), list(ORDER_KEY), out=out, total=total)


def cutoff_key(df: DataFrame, keep: int, order: Sequence[str]) -> Column:
    """Scalar: the order key (a struct) of row number ``keep``; null when there are fewer rows.

    Only the one bucket that holds the cutoff is ever sorted.
    """
    offsets = bucket_offsets(df, source_bucket())
    boundary = offsets.filter((F.col("_before") < keep) & (F.col("_before") + F.col("_rows") >= keep))
    # At most one bucket can straddle the cutoff, so this side is one row.
    inside = (
        df.select(*order, *[b.alias(f"_b{i}") for i, b in enumerate(source_bucket())])
        .join(F.broadcast(boundary), ["_b0", "_b1"])
        .withColumn("_rn", F.row_number().over(W.partitionBy("_b0", "_b1").orderBy(*order)))
        .filter(F.col("_before") + F.col("_rn") == keep)
    )
    return inside.select(F.struct(*order).alias("key")).scalar()


def split_holdout(examples: DataFrame) -> DataFrame:
    """Prefix hold-out: the first hundredth becomes ``val`` once there are enough rows.

    Adds ``split`` and ``pos``, the 0-based position inside the split.
    """
    n = F.col("_n")
    held = F.when(
        n >= K.HOLDOUT_MIN_EXAMPLES, F.greatest(F.lit(1), F.floor(n / K.HOLDOUT_DIVISOR))
    ).otherwise(F.lit(0))
    placed = example_position(examples, out="_pos", total="_n").withColumn("_held", held)
    in_val = F.col("_pos") < F.col("_held")
    return placed.select(
        *examples.columns,
        F.when(in_val, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        F.when(in_val, F.col("_pos")).otherwise(F.col("_pos") - F.col("_held")).alias("pos"),
    )


def assign_shards(split: DataFrame, per_shard: int = K.DEFAULT_EXAMPLES_PER_SHARD) -> DataFrame:
    """Add ``shard``, at most ``per_shard`` rows each, numbered inside the split."""
    return split.withColumn("shard", F.floor(F.col("pos") / F.lit(per_shard)))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in example order (a bounded top-n, not a sort of everything)."""
    return df.orderBy(*ORDER_KEY).limit(n)


def stride(df: DataFrame, world: int, position: str = "pos", out: str = "rank") -> DataFrame:
    """Strided assignment of rows to ``world`` workers."""
    return df.withColumn(out, F.pmod(F.col(position), F.lit(world)).cast("int"))
