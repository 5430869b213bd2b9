"""Pooling of token or chunk vectors ``(id, pos, mask, vec)`` to one vector per id."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from pairforge.constants import POOL_EPS


def mean_pool(tokens: DataFrame, key: str = "id") -> DataFrame:
    """Mean of the unmasked vectors per key; a key without any gives the zero vector.

    The summariser adds vectors up in each task before the shuffle, so a key
    with very many tokens arrives as one partial sum per task.
    """
    kept = F.coalesce(F.col("mask").cast("int"), F.lit(0))
    values = F.col("vec").cast("array<double>")
    zeros = F.array_repeat(F.lit(0.0), F.size("vec"))
    masked = array_to_vector(F.when(kept == 1, values).otherwise(zeros))
    pooled = tokens.groupBy(key).agg(
        Summarizer.metrics("sum").summary(masked).alias("_s"), F.sum(kept).alias("_n")
    )
    divisor = F.greatest(F.col("_n").cast("double"), F.lit(POOL_EPS))
    return pooled.select(key, vector_to_array("_s.sum").alias("_sum"), divisor.alias("_div")).select(
        key, F.transform("_sum", lambda x: (x / F.col("_div")).cast("float")).alias("vec")
    )


def last_pool(tokens: DataFrame, key: str = "id") -> DataFrame:
    """The vector at the last unmasked position per key; the same under left and right padding.

    A key without an unmasked position gives the zero vector, as in ``mean_pool``.
    """
    kept = F.coalesce(F.col("mask").cast("int"), F.lit(0)) == 1
    zeros = F.transform(F.any_value("vec"), lambda x: x * 0)
    # A null order is passed over by max_by.
    last = F.max_by("vec", F.when(kept, F.col("pos")))
    return tokens.groupBy(key).agg(F.coalesce(last, zeros).alias("vec"))
