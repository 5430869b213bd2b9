"""The pipeline, stage by stage, on the smallest table and on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairforge.llm.inputs import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        out.append((name, docs.columns, {r.doc_id: r for r in docs.collect()}))
    return out


def test_rows_that_stay(spark, steps, texts):
    names, kept = [s[0] for s in steps], [s[2] for s in steps]
    assert names == ["language_id", "minhash_dedup", "decontaminate", "pii", "bpe"]
    assert set(kept[0]) == {i for i, t in texts if re.search(r"[^\W\d_]", t)}
    assert set(kept[1]) < set(kept[0]) and set(kept[2]) < set(kept[1]) and set(kept[3]) == set(kept[2]) == set(kept[4])
    columns = table(spark, SF, "documents").columns
    assert all(s[1] == columns for s in steps[:-1])
    assert {i: r.text for i, r in kept[2].items()}.items() <= dict(texts).items()


def test_run_equals_its_stages(spark, steps):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == steps[-1][2]


def test_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    one = corpus_pipeline.language(spark, docs, SF)
    assert one.count() == 7
    two = corpus_pipeline.near_duplicates(spark, one, SF)
    assert sorted(r.doc_id for r in two.collect() if r.doc_id is not None) == [1, 6, 7, 8] and two.count() == 5
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SF).count() == 0
        assert step(spark, docs, SF).columns


def test_a_missing_language_is_filled_and_clashing_columns_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    blind = docs.withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang")))
    wide = blind.withColumns({"_lang": F.lit(1), "_held": F.lit("h"), "_score": F.lit(2), "_found": F.lit(3)})
    got = corpus_pipeline.language(spark, wide, SF)
    assert got.columns == wide.columns and {tuple(r) for r in got.select("_lang", "_held", "_score", "_found").distinct().collect()} == {(1, "h", 2, 3)}
    told = got.join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").filter(F.col("doc_id") % 10 == 0)
    n, right, missing = told.agg(F.count("*"), F.sum((F.col("lang") == F.col("true")).cast("int")), F.sum(F.col("lang").isNull().cast("int"))).first()
    assert n > 80 and right >= 0.95 * n and missing == 0
    assert corpus_pipeline.decontaminated(spark, wide, "/root/testdata/sf0.01").columns == wide.columns
    assert corpus_pipeline.redacted(spark, wide, SF).columns == wide.columns
