"""Key lookups that stay balanced when keys hold a large share of the rows.

The left side has many rows per key, the right side at most one.  A key with
more than ``TARGET_ROWS`` rows is hot: its left rows are spread over as many
sub-keys as it needs to stay below that, and its right row is repeated once per
sub-key; every other row keeps sub-key 0.  Each left row still meets exactly
its own right row, so results do not change.

There are at most rows / ``TARGET_ROWS`` hot keys, none is left out.  They are
joined from a small table, broadcast up to ``BROADCAST_KEYS`` keys and under
Spark's own choice beyond.  Without hot keys the join is a plain join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

TARGET_ROWS = 200_000
BROADCAST_KEYS = 1_000_000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> dict:
    """Hot keys of a table of key counts with their number of sub-keys.  Runs one small job."""
    parts = F.ceil(F.col(n) / F.lit(TARGET_ROWS)).cast("int")
    hot = counts.filter((F.col(n) > TARGET_ROWS) & F.col(key).isNotNull()).select(key, parts.alias("parts"))
    return {row[0]: row[1] for row in hot.toLocalIterator()}


def hot_keys_of(rows: DataFrame, key: str) -> dict:
    """Hot keys of a table of rows; counts are combined on the map side."""
    return hot_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


@dataclass(frozen=True)
class Salting:
    key: str
    hot: Mapping = field(default_factory=dict)

    @property
    def on(self) -> list[str]:
        return [self.key, "_salt"] if self.hot else [self.key]

    def _with_parts(self, df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)[self.key]
        table = df.sparkSession.createDataFrame(list(self.hot.items()), f"`{self.key}` {kind}, _parts int")
        if len(self.hot) <= BROADCAST_KEYS:
            table = F.broadcast(table)
        return df.join(table, self.key, "left")

    def left(self, df: DataFrame, spread: Sequence[str | Column]) -> DataFrame:
        """Spread the rows of hot keys by a hash of ``spread``, so a retry gives the same sub-key."""
        if not self.hot:
            return df
        slot = F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")
        return self._with_parts(df).select(*df.columns, F.coalesce(slot, F.lit(0)).alias("_salt"))

    def right(self, df: DataFrame) -> DataFrame:
        if not self.hot:
            return df
        copies = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
        return self._with_parts(df).select(*df.columns, F.explode(copies).alias("_salt"))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread: Sequence[str | Column],
    hot: Mapping | None = None,
) -> DataFrame:
    """``left.join(right, key, how)`` for inner, left, left_semi and left_anti with salted hot keys.

    ``hot`` comes from ``hot_keys`` over counts that exist already; left out, the
    left side is counted, which reads its key column once more.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    plan = Salting(key, hot_keys_of(left, key) if hot is None else dict(hot))
    joined = plan.left(left, spread).join(plan.right(right), plan.on, how)
    return joined.drop("_salt")
