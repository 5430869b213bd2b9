import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import example, frame, vectors
from pairforge.operators import evaluate as E
from pairforge.operators import skew


def spearman(x, y):
    rx, ry = pd.Series(x).rank(), pd.Series(y).rank()
    return np.corrcoef(rx, ry)[0, 1]


@pytest.mark.parametrize("hot_rows", [2, 10**9])
@pytest.mark.parametrize("parts", [1, 7])
def test_spearman_with_heavy_ties(spark, monkeypatch, hot_rows, parts):
    monkeypatch.setattr(skew, "TARGET_ROWS", hot_rows)
    rng = np.random.default_rng(0)
    n = 900
    lang = np.where(rng.random(n) < 0.6, "en", "fr")
    # A third of the rows shares one value, on either side.
    sim = np.where(rng.random(n) < 0.33, 0.5, np.round(rng.normal(size=n), 3))
    label = np.where(rng.random(n) < 0.4, 5.0, np.round(sim * 2 + rng.normal(size=n), 1))
    rows = [(l, float(s), float(y)) for l, s, y in zip(lang, sim, label)]
    df = spark.createDataFrame(rows, "lang string, sim double, label double").repartition(parts)
    got = {r.lang: r for r in E.spearman(df).collect()}
    for l in ("en", "fr"):
        pick = lang == l
        assert got[l].n == pick.sum() and not got[l].low_sample
        assert got[l].spearman == pytest.approx(spearman(sim[pick], label[pick]), abs=1e-12)


def test_average_ranks(spark):
    df = spark.createDataFrame([("g", 1.0, 2), ("g", 3.0, 1), ("g", 2.0, 4), ("h", 9.0, 3)], "g string, v double, n long")
    for rows in (1, 2, 64):
        got = {(r.g, r.v): r["rank"] for r in E.average_ranks(df, "g", "v", rows).collect()}
        assert got == {("g", 1.0): 1.5, ("g", 2.0): 4.5, ("g", 3.0): 7.0, ("h", 9.0): 2.0}


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_average_ranks_of_many_values(spark, rows):
    values = np.unique(np.random.default_rng(3).normal(size=500))
    counted = [("g", float(v), int(i % 5 + 1)) for i, v in enumerate(values)]
    df = spark.createDataFrame(counted, "g string, v double, n long").repartition(6)
    got = {r.v: r["rank"] for r in E.average_ranks(df, "g", "v", rows).collect()}
    seen, want = 0, {}
    for _, v, n in counted:
        want[v] = seen + (n + 1) / 2
        seen += n
    assert got == want


@pytest.mark.parametrize("n", [20_000, 200_000, 2_000_000])
def test_a_tasks_share_does_not_grow_with_the_rows(spark, n):
    """Two groups of very uneven values, one with nine tenths of the rows; ranges stay monotone and bounded."""
    x = F.rand(5)
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("g"), (x * x * x * x * 1e9).alias("v"), F.lit(1).cast("long").alias("n"))
    df = df.dropDuplicates(["g", "v"])
    ranged = E.value_ranges(df, "g", "v", rows=2_000)
    sizes = ranged.groupBy("g", "_range").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("g", "_range").collect()
    assert max(r.n for r in sizes) <= 2_000 and n / 2_000 <= len(sizes) <= 4 * n / 1_000
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]) if a.g == b.g)


def test_spearman_guards(spark):
    rows = [("few", 0.1, 1.0), ("few", 0.2, 2.0)] + [("flat", float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "lang string, sim double, label double")
    got = {r.lang: r for r in E.sts_report(df, ["few", "flat", "gone"]).collect()}
    assert got["few"].n == 2 and got["few"].spearman is None
    assert got["flat"].n == 5 and got["flat"].spearman is None and got["flat"].low_sample
    assert got["gone"].n == 0 and got["gone"].spearman is None


def test_sts_pairs_and_similarity(spark):
    ab = ["sentence_a", "sentence_b"]
    ex = frame(
        spark,
        [
            example(0, 0, "sts", ["a", "b"], ab, 1.0, lang="en", student=["sts", "document"]),
            example(0, 1, "sts", ["c", "d"], ab, None, lang="en"),
            example(0, 2, "sts", ["e"], ["sentence_a"], 1.0, lang="en"),
            example(0, 3, "bitext", ["f", "g"], ab, 1.0, lang="en"),
            example(0, 4, "sts", ["h", "i"], ab, 2.0, lang="ko"),
        ],
    )
    pairs = E.sts_pairs(ex, ["en", "e"])
    got = pairs.collect()
    assert sorted(r.lang for r in got) == ["e", "en"]
    assert {(r.a_text, r.b_text) for r in got} == {("sts: a", "b")}
    emb = vectors(spark, {got[0].a_id: [1, 0], got[0].b_id: [3, 4]}).unionByName(vectors(spark, {got[0].a_id: [0, 1]}, "query"))
    assert {r.sim for r in E.pair_similarity(pairs, emb).collect()} == {4.0}


@pytest.mark.parametrize("block", [3, 256])
def test_retrieval_against_a_loop(spark, block):
    rng = np.random.default_rng(1)
    n, limit = 14, 11
    roles = ["query", "positive", "negative"]
    rows = [example(0, i, "retrieval", [f"q{i}", f"p{i % 9}", "n"], roles, lang="en" if i % 3 else "ko") for i in range(n)]
    rows.append(example(0, 99, "retrieval", ["q", "n"], ["query", "negative"]))
    ex = frame(spark, rows)
    chosen = E.retrieval_set(ex, limit)
    picked = chosen.orderBy("i").collect()
    assert [r.i for r in picked] == list(range(limit)) and picked[1].q_text == "ret: q1" and picked[1].p_text == "p1"
    ids = {r.q_id for r in picked} | {r.p_id for r in picked}
    vec = {i: rng.integers(-3, 4, size=5).tolist() for i in sorted(ids)}
    found = E.retrieval_vectors(chosen, vectors(spark, vec))
    got = {r.i: r["rank"] for r in E.own_ranks(found, block=block).collect()}
    q = np.array([vec[r.q_id] for r in picked], float)
    p = np.array([vec[r.p_id] for r in picked], float)
    s = q @ p.T
    want = {i: 1 + sum(1 for j in range(limit) if j != i and (s[i, j] > s[i, i] or (s[i, j] == s[i, i] and j < i))) for i in range(limit)}
    assert got == want
    m = E.retrieval_metrics(E.own_ranks(found, block=block)).first()
    assert m.n == limit and m.recall_at_1 == pytest.approx(np.mean([r == 1 for r in want.values()]))
    assert m.mrr == pytest.approx(np.mean([1 / r for r in want.values()]))
    assert [(r.lang, r.n) for r in E.lang_counts(chosen).collect()] == [("en", 7), ("ko", 4)]


def test_ranks_reach_to_the_last_row(spark):
    """Row k scores its own passage below those of the k rows before it."""
    n = 8
    q = np.tril(np.ones((n, n))) - np.eye(n) * 0.5
    rows = [(i, q[i].tolist(), np.eye(n)[i].tolist()) for i in range(n)]
    found = spark.createDataFrame(rows, "i long, q_vec array<float>, p_vec array<float>")
    for block in (1, 3, 100):
        assert {r.i: r["rank"] for r in E.own_ranks(found, block=block).collect()} == {i: i + 1 for i in range(n)}
    assert E.own_ranks(found.limit(0)).count() == 0


@pytest.mark.parametrize("digits", [12, 2])
def test_blocks_out_of_reach_are_skipped(spark, digits):
    """Passages in well-parted clusters: exact ranks, and most blocks are not scored."""
    rng = np.random.default_rng(4)
    n = 1500
    centres = rng.normal(size=(30, 24))
    p = centres[rng.integers(0, 30, n)] + 0.05 * rng.normal(size=(n, 24))
    p[:40] = p[0]
    q = p + 0.05 * rng.normal(size=(n, 24))
    p, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (p, q))
    rows = [(i, q[i].tolist(), p[i].tolist()) for i in range(n)]
    found = spark.createDataFrame(rows, "i long, q_vec array<float>, p_vec array<float>")
    got = {r.i: r for r in E.own_ranks(found, block=20, digits=digits).collect()}
    s = q.astype(np.float32).astype(float) @ p.astype(np.float32).astype(float).T
    s = np.round(s, digits)
    own, j = np.diag(s)[:, None], np.arange(n)[None, :]
    better = (s > own) | ((s == own) & (j < np.arange(n)[:, None]))
    np.fill_diagonal(better, False)
    assert len(got) == n and [got[i]["rank"] for i in range(n)] == (1 + better.sum(1)).tolist()
    # All forty queries of one repeated passage are among them.
    share = sum(r.n_scored for r in got.values()) / sum(r.n_blocks for r in got.values())
    assert share < 0.3


def test_all_examples_are_evaluated_by_default(spark):
    rows = [example(i % 3, i, "retrieval", [f"q{i}", f"p{i}"], ["query", "positive"]) for i in range(30)]
    ex = frame(spark, rows + [example(0, 99, "sts", ["a", "b"], ["sentence_a", "sentence_b"])])
    every = E.retrieval_set(ex).orderBy("i").collect()
    assert [(r.i, r.source_seq) for r in every] == [(i, i // 10) for i in range(30)]
    assert E.retrieval_set(ex, 7).orderBy("i").collect() == every[:7]
    m = spark.range(1).select(E.retrieval_available(ex).alias("m")).first().m
    assert m == 30


def test_retrieval_guard(spark):
    ranks = spark.createDataFrame([(0, 1)], "i int, rank long")
    assert E.retrieval_metrics(ranks).first().asDict() == {"n": 1, "recall_at_1": None, "mrr": None}
    assert E.retrieval_metrics(ranks.limit(0)).first().n == 0
