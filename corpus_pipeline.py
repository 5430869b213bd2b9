"""Training-data pipeline over ``documents``: five stages, each one operator.

Every stage is a function of (spark, docs, sf_dir); its result is written as
Parquet below ``spark.checkpoint.dir`` and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairforge.llm import bpe, decontaminate, langid, minhash_dedup, pii
from pairforge.llm.inputs import VOCABULARY, fresh, table
from pairforge.session import stage

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (language ``und``); where ``lang`` is missing it becomes the predicted one."""
    held, lang, score = (fresh(docs, name) for name in ("_held", "_lang", "_score"))
    model = langid.fit(docs.withColumn(held, langid.held_out("doc_id")).filter(~F.col(held)))
    found = langid.predict(docs, model, out=lang, score=score)
    # None or one for each row; a filter would be pushed down with a second prediction of its own.
    known = F.explode(F.filter(F.array(lang), lambda x: x != langid.UNKNOWN))
    told = found.select(*docs.columns, known.alias(lang))
    return told.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest document of each group of near-duplicates; repeated rows of it once.

    Rows without an id are in no group and all stay.
    """
    groups = minhash_dedup.near_duplicates(docs)
    kept = groups.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    once = docs.join(kept, "doc_id", "left_semi").select(docs.columns).distinct()
    return once.unionByName(docs.filter("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    out = fresh(docs, "_found")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.filter(F.col(out).n_hit == 0).select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by the name of its kind; ``n_chars`` follows the new text."""
    marked = pii.redact(docs, "text")
    return marked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the digests of ids and decoded text."""
    coded = bpe.encode_decode(docs, VOCABULARY)
    return coded.select("doc_id", "lang", "source", "n_chars", *bpe.digests(coded))


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("pii", redacted),
    ("bpe", encoded),
]

#: Trees of stage four and the tokens of stage five cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
