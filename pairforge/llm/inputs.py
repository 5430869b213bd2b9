"""The tables that the registered queries read, and small column helpers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The vocabulary of the registered queries; operators take any path.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and the whole ``text`` of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def ids_and_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text``; without an alias where none is needed, so equal scans can be shared."""
    types = dict(df.dtypes)
    key = F.col(doc_id) if types[doc_id] == "bigint" else F.col(doc_id).cast("long")
    return df.select(
        key if doc_id == "doc_id" and types[doc_id] == "bigint" else key.alias("doc_id"),
        F.col(text) if text == "text" else F.col(text).alias("text"),
    )


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once; inside a lambda a column would be worked out at every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
