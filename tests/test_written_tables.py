"""Queries over written tables against their SQL, on rows of their own."""

import hashlib
import re
import tempfile
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from compare import compare
from helpers import example, frame
from pairforge import constants as K
from pairforge.checks import fixtures as fx, oracles, queries
from pairforge.operators import batching
from pairforge.plans import jobs
from pairforge.sources import tables

QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def sf_dir(spark):
    """Small tables: texts that repeat, blank and padded ones, gaps between ids, documents without a label."""
    folder = tempfile.mkdtemp(prefix="pairforge-test-")
    blank = {7: " \t", 19: None, 30: ""}
    docs = [
        (i, blank.get(i, f" text {i % 90} of\n{'many ' * (i % 4)}words"), ("en", "fr", "de")[i % 3], "s", 20)
        for i in range(300)
        if i % 41
    ]
    turns = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c % 20}") for c in range(40) for t in range(2 + c % 5)]
    rows = {
        "documents": docs,
        "labels": [(i, i % 2, i % 3 % 2) for i in range(0, 300, 2)],
        "conversations": turns,
        "embeddings": [(i, [float((i * 7 + k * k) % 11 - 5) / 8 for k in range(64)], i % 10) for i in range(60)],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, fx.SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in fx.SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet/*.parquet'")
    return con


def test_checksums_where_a_task_writes_several_shards(spark, sf_dir, con, monkeypatch):
    """Beyond ``WRITERS`` shards a file's number is its task's, not its shard's."""
    monkeypatch.setattr(tables, "WRITERS", 3)
    assert compare(spark, con, QUERIES["q_checksums"], ORACLES["q_checksums"], sf_dir) is None


@pytest.mark.parametrize("name", ["q_eval_job", "q_texts_roundtrip", "q_example_at"])
def test_written_tables_hold_long_texts_once(spark, sf_dir, con, name, monkeypatch):
    """Shards and texts are written in a codec that reaches over a long text."""
    seen, scratch = [], queries.scratch
    monkeypatch.setattr(queries, "scratch", lambda *args: (seen.append(scratch(*args)), seen[-1])[1])
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf_dir) is None
    files = [f for path in seen for f in Path(path.removeprefix("file:")).rglob("*.parquet")]
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files}
    assert codecs == {"ZSTD"}


# ------------------------------------------------------------ how often texts move


def moves(df, *columns):
    """Shuffles of a plan that carry one of the columns."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffles = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    return sum(any(re.search(rf"(^|, ){c}#", s) for c in columns) for s in shuffles)


def staged_columns(monkeypatch, module):
    """Columns of everything that a module stages, by name."""
    seen, stage = {}, module.stage
    monkeypatch.setattr(module, "stage", lambda df, name="stage", **options: (seen.update({name: df.columns}), stage(df, name, **options))[1])
    return seen


def test_pairs_of_documents_move_texts_once(spark, sf_dir):
    assert moves(fx.sts(spark, sf_dir), "text", "sentence1", "sentence2", "doc") == 1


def test_pairs_of_documents_at_edges_of_blocks(spark):
    """Repeated and missing ids, negative ones, and neighbours in different blocks."""
    folder = tempfile.mkdtemp(prefix="pairforge-test-")
    ids = [-1025, -1024, -1, 0, 1, 1, 2, 1022, 1023, 1024, 1024, 1025, None, None, 2047, 2048, 9000]
    docs = [(i, None if n == 3 else f"t{n}", "en", "s", 2) for n, i in enumerate(ids)]
    labels = [(i, 1, n % 2) for n, i in enumerate((0, 1, 1, 1023, 2047, 9000, None))]
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("labels", labels)):
        spark.createDataFrame(rows, fx.SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    key = lambda row: str(tuple(row))
    want = sorted(con.execute(oracles.CTES["fx_sts"]).fetchall(), key=key)
    got = fx.sts(spark, folder).select("row_ord", "lang", "sentence1", "sentence2", "score").collect()
    assert sorted((tuple(r) for r in got), key=key) == want


def test_a_language_with_more_documents_sends_only_the_paired_ones(spark, sf_dir, con):
    rows = [tuple(r) for r in fx.bitext(spark, sf_dir).select("row_ord", F.md5("en"), F.md5("fr")).collect()]
    got = sorted(r for r in rows if None not in r)
    want = con.execute(f"SELECT row_ord, md5(en), md5(fr) FROM ({oracles.CTES['fx_bitext']}) WHERE en IS NOT NULL AND fr IS NOT NULL").fetchall()
    assert got == sorted(want) and got


@pytest.mark.parametrize("name", ["q_distinct_texts", "q_query_prompted", "q_encode_texts", "q_batches"])
def test_texts_of_examples_move_once(spark, sf_dir, con, name):
    query = QUERIES[name](spark, sf_dir)
    assert moves(query, "texts", "text", "_wide", "doc") == 1
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf_dir) is None


def test_losses_of_an_encoder_stage_no_texts(spark, sf_dir, con, monkeypatch):
    seen = staged_columns(monkeypatch, jobs)
    assert compare(spark, con, QUERIES["q_encoder_losses"], ORACLES["q_encoder_losses"], sf_dir) is None
    assert "text_ids" in seen["batches"] and "texts" not in seen["batches"]


def test_texts_come_back_to_rows_that_share_a_key(spark):
    """Two rows alike, one with another text, one without a number; one of the alike is dropped on the way."""
    rows = [example(0, 5, "sts", t, ["sentence_a", "sentence_b"]) for t in (["a", "b"], ["a", "b"], ["a", "c"])]
    ex = frame(spark, [*rows, example(0, None, "sts", ["d", "e"], ["sentence_a", "sentence_b"])])
    dealt = ex.drop("texts").withColumn("slot", F.monotonically_increasing_id())
    got = batching.with_texts(dealt, ex)
    assert got.columns == [*ex.columns, "slot"]
    assert sorted(r.texts for r in got.collect()) == [["a", "b"], ["a", "b"], ["a", "c"], ["d", "e"]]
    assert len({r.slot for r in got.collect()}) == 4
    fewer = ex.drop("texts").filter("row_ord = 5").orderBy("text_ids").dropDuplicates(["text_ids"])
    assert sorted(r.texts for r in batching.with_texts(fewer, ex).collect()) == [["a", "b"], ["a", "c"]]


def test_student_texts_of_rows_that_share_a_key(spark):
    rows = [example(0, 5, "sts", t, ["sentence_a", "sentence_b"], student=["sts", "document"]) for t in (["a", "b"], ["a", "b"], ["a", "c"], ["c", "a"])]
    ex = batching.student_ids(frame(spark, rows))
    sides = ex.select("*", F.posexplode("student_ids").alias("side", "student_id"))
    got = sorted((r.text_id, r.text) for r in batching.student_texts(sides, ex).collect())
    prompt = K.STUDENT_PROMPTS["sts"]
    want = {prompt + "a", "b", "c", prompt + "c", "a"} if prompt else {"a", "b", "c"}
    assert got == sorted((hashlib.sha1(t.encode()).hexdigest(), t) for t in want)
