"""Declared schemas.  Shards are always written with these, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

ORDER_KEY = ("source_seq", "row_ord")

EXAMPLE = T.StructType(
    [
        T.StructField("source_seq", T.IntegerType()),
        T.StructField("row_ord", T.LongType()),
        T.StructField("example_id", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("teacher_prompt_names", T.ArrayType(T.StringType())),
        T.StructField("student_prompt_names", T.ArrayType(T.StringType())),
        T.StructField("label", T.DoubleType()),
        T.StructField("text_ids", T.ArrayType(T.StringType())),
    ]
)

SHARD = T.StructType(
    EXAMPLE.fields
    + [
        T.StructField("pos", T.LongType()),
        T.StructField("split", T.StringType()),
        T.StructField("shard", T.LongType()),
    ]
)

TEXT = T.StructType(
    [
        T.StructField("text_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)

EMBEDDING = T.StructType(
    [
        T.StructField("text_id", T.StringType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
        T.StructField("kind", T.StringType()),
    ]
)
