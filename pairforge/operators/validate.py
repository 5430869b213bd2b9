"""Record validation: the first failing rule wins and names the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairforge import constants as K
from pairforge.functions.text import not_blank
from pairforge.schemas import EXAMPLE

LISTS = ("texts", "roles", "teacher_prompt_names", "student_prompt_names")


def with_optional_fields(df: DataFrame) -> DataFrame:
    """Add ``label`` and ``text_ids`` as typed nulls where the frame lacks them."""
    for name in ("label", "text_ids"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(EXAMPLE[name].dataType))
    return df


def validation_error(columns: list[str]) -> Column:
    """Null for a valid record, else the code of the first rule it breaks."""
    missing = [f for f in K.REQUIRED_FIELDS if f not in columns]
    if missing:
        return F.lit(f"missing_field:{missing[0]}")
    sizes = [F.coalesce(F.size(c), F.lit(-1)) for c in LISTS]
    unequal = (sizes[0] != sizes[1]) | (sizes[0] != sizes[2]) | (sizes[0] != sizes[3])
    known_role = lambda r: F.coalesce(r.isin(*K.ROLES), F.lit(False))
    return (
        F.when(~F.coalesce(F.col("task").isin(*K.TASKS), F.lit(False)), "invalid_task")
        .when(sizes[0] <= 0, "empty_texts")
        .when(unequal, "unequal_lengths")
        .when(~F.forall("roles", known_role), "invalid_role")
        .when(~F.forall("texts", not_blank), "blank_text")
    )


def annotate(df: DataFrame) -> DataFrame:
    return with_optional_fields(df).withColumn("error", validation_error(df.columns))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): valid records, and the rest with their ``error``."""
    checked = annotate(df)
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(
        F.col("error").isNotNull()
    )


def require_valid(df: DataFrame) -> DataFrame:
    """The same records; the job fails on the first invalid one."""
    bad = F.concat_ws(" ", F.lit("invalid example"), F.col("example_id"), F.col("error"))
    checked = annotate(df)
    ok = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(bad).cast("boolean"))
    return checked.filter(ok).drop("error")


def error_counts(df: DataFrame) -> DataFrame:
    """Number of records per error; valid records count under ``ok``."""
    return (
        annotate(df)
        .groupBy(F.coalesce("error", F.lit("ok")).alias("error"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
