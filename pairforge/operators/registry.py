"""Task and language registries as small dimension tables.

Their rows are the package's own unless a mapping of a configuration is given:
``{"sts": {"enabled": True, "student_prompt": ...}}`` and
``{"en": {"name": "English", "enabled": True}}``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge import constants as K

TASK_FIELDS = ("enabled", "student_prompt", "teacher_prompt_query", "teacher_prompt_doc")
LANGUAGE_FIELDS = ("name", "enabled")


def _rows(given: Mapping[str, Mapping] | None, fields: Sequence[str], own: Sequence[tuple]) -> list[tuple]:
    """Rows of a mapping; a missing ``enabled`` is true, other missing fields are null."""
    if given is None:
        return list(own)
    return [(key, *[entry.get(f, True if f == "enabled" else None) for f in fields]) for key, entry in given.items()]


def _active(registry: DataFrame, key: str, active: Sequence[str] | None) -> DataFrame:
    enabled = registry.filter("enabled").drop("enabled")
    return enabled if active is None else enabled.filter(F.col(key).isin(*active))


def task_registry(spark: SparkSession, tasks: Mapping[str, Mapping] | None = None) -> DataFrame:
    return spark.createDataFrame(
        _rows(tasks, TASK_FIELDS, K.TASK_REGISTRY),
        "task string, enabled boolean, student_prompt string, "
        "teacher_prompt_query string, teacher_prompt_doc string",
    )


def language_registry(spark: SparkSession, languages: Mapping[str, Mapping] | None = None) -> DataFrame:
    return spark.createDataFrame(
        _rows(languages, LANGUAGE_FIELDS, K.LANGUAGE_REGISTRY), "lang string, name string, enabled boolean"
    )


def with_task_settings(
    examples: DataFrame, tasks: Mapping[str, Mapping] | None = None, active: Sequence[str] | None = None
) -> DataFrame:
    """Examples of enabled (and active) tasks with the prompt names the registry declares."""
    settings = _active(task_registry(examples.sparkSession, tasks), "task", active)
    return examples.join(F.broadcast(settings), "task")


def outside_languages(
    examples: DataFrame,
    lang: str = "lang",
    active: Sequence[str] | None = None,
    languages: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Examples whose base language is not enabled (or not in ``active``)."""
    registry = _active(language_registry(examples.sparkSession, languages), "lang", active)
    enabled = registry.select(F.col("lang").alias("_base"))
    base = F.split_part(F.col(lang), F.lit("-"), F.lit(1))
    return examples.join(F.broadcast(enabled), base == F.col("_base"), "left_anti")
