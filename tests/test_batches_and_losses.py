import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import example, frame, pairs_of, random_examples, vectors
from pairforge.operators import batching as B
from pairforge.operators import metrics as M
from pairforge.plans import jobs

POINTS = "step long, rank int, local_idx int, s_vec array<float>, t_vec array<float>, valid boolean"
PAIRS = "step long, rank int, i int, j int"


def capped(spark, rows, max_texts=256):
    df = frame(spark, rows).withColumns(
        {"step": F.lit(0).cast("long"), "rank": F.lit(0), "slot": F.col("row_ord").cast("int")}
    )
    return B.cap_batch_texts(df, max_texts)


def test_sts_example(spark):
    c = capped(spark, [example(0, 0, "sts", ["hello world", "hi earth"], ["sentence_a", "sentence_b"], 4.0, student=["sts", "sts"])])
    rows = B.batch_texts(c).orderBy("local_idx").collect()
    assert [r.use_query for r in rows] == [True, False]
    assert [r.student_text for r in rows] == ["sts: hello world", "hi earth"]
    assert pairs_of(B.graded_pairs(c), "i", "j") == [(0, 1)]
    assert pairs_of(B.positive_pairs(c), "i", "j") == [(0, 1), (1, 0)]


def test_pair_rules(spark):
    ab, other = ["sentence_a", "sentence_b"], ["document", "document"]
    rows = [
        example(0, 0, "sts", ["a", "b"], ab, 2.5),
        example(0, 1, "sts", ["a", "b"], ab, 2.4),
        example(0, 2, "sts", ["a", "b"], ab, None),
        example(0, 3, "bitext", ["a", "b"], ab),
        example(0, 4, "bitext", ["a", "b"], other),
        example(0, 5, "sts", ["a", "b"], other, 1.0),
        example(0, 6, "sts", ["a", "b"], other, 3.0),
        example(0, 7, "retrieval", ["q", "p", "p2", "n", "q2"], ["query", "positive", "positive", "negative", "query"]),
        example(0, 8, "sts", ["a", "b"], ["sentence_b", "document"], 3.0),
    ]
    c = capped(spark, rows)
    start = {r.row_ord: r.start for r in c.collect()}
    both = lambda pairs: sorted(pairs + [(j, i) for i, j in pairs])
    two = lambda k: (start[k], start[k] + 1)
    q = start[7]
    assert pairs_of(B.graded_pairs(c), "i", "j") == sorted(two(k) for k in (0, 1, 2, 3, 4, 5, 6, 8))
    assert pairs_of(B.positive_pairs(c), "i", "j") == both(
        [two(k) for k in (0, 2, 3, 4, 6, 8)] + [(q, q + 1), (q, q + 2), (q + 4, q + 1), (q + 4, q + 2)]
    )


def test_cut_examples(spark):
    rows = [example(0, i, "retrieval", ["q", "p", "n"], ["query", "positive", "negative"]) for i in range(3)]
    c = capped(spark, rows, max_texts=4)
    assert pairs_of(c, "row_ord", "start", "kept") == [(0, 0, 3), (1, 3, 1)]
    assert pairs_of(B.batch_texts(c), "local_idx", "row_ord", "side") == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0)]
    assert pairs_of(B.positive_pairs(c), "i", "j") == [(0, 1), (1, 0)]


@pytest.mark.parametrize("world, size", [(1, 7), (3, 4)])
def test_batches_against_a_plain_loop(spark, world, size):
    ex = random_examples(spark, 70)
    rows = sorted(
        ((r.source_seq, r.row_ord) for r in ex.collect()),
        key=lambda k: hashlib.sha1(f"5:2:{k[0]}:{k[1]}".encode()).hexdigest(),
    )
    want = []
    for rank in range(world):
        mine = rows[rank::world]
        for step in range(len(rows) // world // size):
            want += [(*k, step, rank, slot) for slot, k in enumerate(mine[step * size : (step + 1) * size])]
    for parts in (1, 13):
        got = B.assign_batches(ex.repartition(parts), seed=5, epoch=2, world=world, batch_size=size)
        assert pairs_of(got, "source_seq", "row_ord", "step", "rank", "slot") == sorted(want)


def test_eligible(spark):
    ex = frame(spark, [example(0, i, "sts", [f"a{i}", f"b{i % 2}"], ["query", "positive"]) for i in range(4)])
    ids = {r.row_ord: r.text_ids for r in ex.collect()}
    known = {i for k in (0, 1, 2) for i in ids[k]} - {ids[1][0]}
    assert pairs_of(B.eligible(ex, vectors(spark, {i: [1] for i in known})), "row_ord") == [(0,), (2,)]
    blank = ex.withColumn("text_ids", F.when(F.col("row_ord") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("text_ids")))
    assert 0 not in {r.row_ord for r in B.eligible(blank, vectors(spark, {i: [1] for i in known})).collect()}


# ---------------------------------------------------------------- losses


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / max(math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)), 1e-12)


def brute(student, teacher, positive, graded, tau=0.07, gamma=2.0, t=2.0):
    """Independent element-by-element computation of the four losses."""
    n = len(student)
    cs = [[cosine(a, b) for b in student] for a in student]
    ct = [[cosine(a, b) for b in teacher] for a in teacher]
    kl = 0.0
    for i in range(n):
        others = [j for j in range(n) if j != i]
        zs = sum(math.exp(cs[i][j] / tau) for j in others)
        zt = sum(math.exp(ct[i][j] / tau) for j in others)
        for j in others:
            p, q = math.exp(ct[i][j] / tau) / zt, math.exp(cs[i][j] / tau) / zs
            kl += p * math.log(p / q)
    focal = []
    for i, j in sorted(set(positive)):
        neg = [k for k in range(n) if k != i and (i, k) not in positive]
        if i == j or not neg:
            continue
        w = [min(max((ct[i][k] + 1) / 2, 0), 1) ** gamma for k in neg]
        total = sum(w) + 1e-8
        top = max([cs[i][j]] + [cs[i][k] for k in neg]) / tau
        e = math.exp(cs[i][j] / tau - top)
        miss = sum(a / total * math.exp(cs[i][k] / tau - top) for a, k in zip(w, neg))
        focal.append(-math.log(e / (e + miss + 1e-8)))
    off = [math.exp(t * cs[i][j]) for i in range(n) for j in range(n) if i != j]
    gaps = [(cs[i][j] - ct[i][j]) ** 2 for i, j in graded if i != j]
    mean = lambda v: sum(v) / len(v) if v else 0.0
    return kl / n, mean(focal), math.log(mean(off) + 1e-8), mean(gaps)


def points(rng, n, s_dim, t_dim, valid=None, rank=0):
    s, t = rng.normal(size=(n, s_dim)), rng.normal(size=(n, t_dim))
    valid = [True] * n if valid is None else valid
    rows = [(0, rank, i, s[i].tolist(), t[i].tolist(), bool(valid[i])) for i in range(n)]
    return rows, s.astype(np.float32).tolist(), t.astype(np.float32).tolist()


def run(spark, rows, positive, graded, **kw):
    pair = lambda ps: spark.createDataFrame([(0, 0, i, j) for i, j in ps], PAIRS)
    kw.setdefault("world", 1)
    kw.setdefault("max_texts", 256)
    out = M.batch_losses(
        spark.createDataFrame(rows, POINTS).repartition(3), pair(positive), pair(graded), **kw
    ).orderBy("rank").collect()
    return out


def parts(row):
    return [row.loss_kl, row.loss_focal, row.loss_disp, row.loss_sts]


def test_losses_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, s, t = points(rng, 8, 12, 20)
    positive, graded = [(0, 1), (1, 0), (2, 3), (3, 2), (4, 4)], [(0, 1), (2, 3), (2, 3), (5, 5), (1, 99)]
    got = run(spark, rows, positive, graded)[0]
    want = brute(s, t, positive, [(0, 1), (2, 3), (2, 3), (5, 5)])
    assert np.allclose(parts(got), want, atol=1e-9)
    assert got.loss == pytest.approx(want[0] + 0.5 * want[1] + 0.01 * want[2] + want[3])
    assert (got.n, got.n_valid) == (256, 8)


def test_invalid_rows_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows, s, t = points(rng, 4, 32, 32)
    pads = [(0, 0, i, [0.0] * 32, [0.0] * 32, False) for i in range(4, 16)]
    beyond = [(0, 0, 300, [1.0] * 32, [1.0] * 32, True)]
    positive, graded = [(0, 1), (1, 0), (0, 9)], [(2, 3)]
    alone, padded = run(spark, rows, positive, graded)[0], run(spark, rows + pads + beyond, positive, graded)[0]
    assert np.allclose(parts(alone), parts(padded), atol=1e-12) and padded.n_valid == 4
    assert np.allclose(parts(alone), brute(s, t, [(0, 1), (1, 0)], graded), atol=1e-9)


def test_matched_geometry(spark):
    rng = np.random.default_rng(3)
    rows, _, t = points(rng, 6, 16, 16)
    same = [(st, r, i, tv, tv, v) for (st, r, i, _, tv, v) in rows]
    got = run(spark, same, [(0, 1)], [(0, 1), (2, 3), (4, 5)])[0]
    assert got.loss_sts < 1e-12 and abs(got.loss_kl) < 1e-12 and got.loss_focal > 0


def test_degenerate_batches(spark):
    rng = np.random.default_rng(4)
    rows, *_ = points(rng, 1, 4, 4)
    assert parts(run(spark, rows, [(0, 0)], [(0, 0)])[0]) == [0, 0, 0, 0]
    two, *_ = points(rng, 2, 4, 4)
    # Both are each other's positive: no negatives, no focal loss.
    assert run(spark, two, [(0, 1), (1, 0)], [])[0].loss_focal == 0


def test_ranks_share_matrices_but_not_graded_pairs(spark):
    rng = np.random.default_rng(5)
    a, sa, ta = points(rng, 3, 8, 8)
    b, sb, tb = points(rng, 4, 8, 8, rank=1)
    pos = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 2, 3)], PAIRS)
    graded = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 3), (0, 1, 2, 9)], PAIRS)
    got = M.batch_losses(spark.createDataFrame(a + b, POINTS), pos, graded, world=2, max_texts=8).orderBy("rank").collect()
    first = brute(sa + sb, ta + tb, [(0, 1), (5, 6)], [(0, 1)])
    second = brute(sa + sb, ta + tb, [(0, 1), (5, 6)], [(3, 6)])
    assert np.allclose(parts(got[0]), first, atol=1e-9) and np.allclose(parts(got[1]), second, atol=1e-9)
    assert got[0].n == 16 and got[0].n_valid == 7


def test_losses_need_the_world_and_refuse_other_ranks(spark):
    rng = np.random.default_rng(6)
    rows = [r for rank in range(3) for r in points(rng, 4, 4, 4, rank=rank)[0]]
    vectors_, pairs = spark.createDataFrame(rows, POINTS), spark.createDataFrame([(0, 0, 0, 1)], PAIRS)
    with pytest.raises(TypeError):
        M.batch_losses(vectors_, pairs, pairs)
    with pytest.raises(Exception, match="rank outside 0..1: 2"):
        M.batch_losses(vectors_, pairs, pairs, world=2, max_texts=8).collect()
    assert M.batch_losses(vectors_, pairs, pairs, world=3, max_texts=8).filter("n_valid = 12").count() == 3


def test_ranks_get_equally_many_batches(spark):
    ex = random_examples(spark, 15)
    got = B.assign_batches(ex, world=2, batch_size=8)
    assert got.count() == 0 and B.assign_batches(ex, world=2, batch_size=7).groupBy("rank").count().count() == 2


def test_measure_alignment_end_to_end(spark):
    ex = random_examples(spark, 60)
    ids = sorted({i for r in ex.collect() for i in r.text_ids})
    rng = np.random.default_rng(6)
    vec = {i: rng.normal(size=6).tolist() for i in ids}
    teacher = vectors(spark, vec).unionByName(vectors(spark, {i: v[::-1] for i, v in list(vec.items())[:9]}, "query"))
    student = vectors(spark, {i: v[:3] for i, v in vec.items()})
    out = jobs.measure_alignment(ex, teacher, student, world=2, batch_size=5, max_texts=12)
    rows = out.collect()
    assert len(rows) == 12 and all(r.loss > 0 and r.n_valid <= 24 for r in rows)
    report = M.step_report(out, every=2).collect()
    assert sorted(r.step for r in report) == [0, 2, 4]


@pytest.mark.parametrize("dims", [(12, 20), (8, 8)])
def test_losses_are_equal_for_any_number_of_tiles(spark, dims):
    """One task against 4 and 256 pairs of tiles; ranks, repeated and absent pairs, gaps in the indices."""
    rng = np.random.default_rng(8)
    rows, pos, graded = [], [], []
    for step in range(3):
        for rank in range(2):
            n = [30, 9, 1][step]
            for i in sorted(rng.choice(32, n, replace=False).tolist()):
                rows.append((step, rank, i, rng.normal(size=dims[0]).tolist(), rng.normal(size=dims[1]).tolist(), bool(rng.random() < 0.9)))
            pos += [(step, rank, int(a), int(b)) for a, b in rng.integers(0, 34, (25, 2))] + [(step, rank, 3, 4)] * 2
            graded += [(step, rank, int(a), int(b)) for a, b in rng.integers(0, 34, (25, 2))] + [(step, rank, 5, 6)] * 2
    frames = spark.createDataFrame(rows, POINTS), spark.createDataFrame(pos, PAIRS), spark.createDataFrame(graded, PAIRS)
    settings = M.LossSettings(temperature=0.002)
    for kw in ({}, {"parts": ("kl", "disperse")}, {"settings": settings}):
        one, *others = [
            [tuple(r) for r in M.batch_losses(*frames, world=2, max_texts=32, tile_rows=t, **kw).orderBy("step", "rank").collect()] for t in (64, 32, 4)
        ]
        assert len(one) >= 5
        for many in others:
            assert [r[:2] + r[-2:] for r in many] == [r[:2] + r[-2:] for r in one]
            assert np.allclose([r[2:7] for r in many], [r[2:7] for r in one], rtol=1e-9, atol=1e-11)


def test_tiled_losses_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, s, t = points(rng, 11, 12, 20)
    positive, graded = [(0, 1), (1, 0), (2, 9), (9, 2), (4, 4)], [(0, 1), (2, 10), (2, 10), (5, 5)]
    got = run(spark, rows, positive, graded, max_texts=12, tile_rows=4)[0]
    assert np.allclose(parts(got), brute(s, t, positive, graded), atol=1e-9)


def test_cut_points_are_counted(spark):
    rng = np.random.default_rng(10)
    rows, *_ = points(rng, 10, 4, 4, valid=[True] * 9 + [False])
    got = M.cut_points(spark.createDataFrame(rows, POINTS), 4).collect()
    assert [tuple(r) for r in got] == [(0, 0, 5)]


@pytest.mark.parametrize("tile_rows", [2, 3, 2048])
def test_pairwise_cosine(spark, tile_rows):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(5, 3))
    rows = [(0, i, v.tolist()) for i, v in enumerate(m)] + [(1, 3, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "step int, idx int, vec array<float>")
    got = {(r.step, r.idx): r for r in M.pairwise_cosine(df, max_rows=5, nearest=3, tile_rows=tile_rows).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = u @ u.T
    for i in range(5):
        r, others = got[0, i], sorted(((-cos[i, j], j) for j in range(5) if j != i))
        assert r.n == 5 and np.allclose([r.total, r.lowest, r.highest], [cos[i].sum(), cos[i].min(), -others[0][0]], atol=1e-6)
        assert [x.place for x in r.near] == [j for _, j in others[:3]]
    assert got[1, 3].n == 1 and got[1, 3].highest is None and got[1, 3].near == []
    with pytest.raises(Exception, match="exceeds"):
        M.pairwise_cosine(df, max_rows=4).collect()
