import os
import tempfile
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import example, frame, pairs_of, vectors
from pairforge.functions.vectors import l2_normalize, round_to_half, row_dot
from pairforge.operators import encode, keys, lookup, membership, ordering, pooling, skew
from pairforge.sources import tables


def test_normalize_half_and_dot_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 24)).astype(np.float32)
    m[3] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, vec array<float>").repartition(3)
    got = df.select("id", l2_normalize("vec").alias("u"), round_to_half("vec").alias("h"), row_dot("vec", "vec").alias("d"))
    for r in got.collect():
        v = m[r.id].astype(np.float64)
        assert np.allclose(r.u, v / max(np.linalg.norm(v), 1e-12), atol=1e-7)
        assert r.h == m[r.id].astype(np.float16).astype(np.float32).tolist()
        assert abs(r.d - v @ v) < 1e-9


def test_nulls_and_mixed_lengths(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, None), (2, [2.0]), (3, [])], "id int, vec array<float>").coalesce(1)
    got = {r.id: (r.u, r.d) for r in df.select("id", l2_normalize("vec").alias("u"), row_dot(F.col("vec"), F.when(F.col("id") == 0, F.col("vec"))).alias("d")).collect()}
    assert np.allclose(got[0][0], [0.6, 0.8]) and got[0][1] == 25.0
    assert got[1] == (None, None) and got[2] == ([1.0], None) and got[3] == ([], None)


def test_pooling(spark):
    rows = [
        ("a", 0, 1, [1.0, 2.0]), ("a", 1, 1, [3.0, 6.0]), ("a", 2, 0, [9.0, 9.0]),
        ("left", 0, 0, [7.0, 7.0]), ("left", 1, 1, [5.0, 4.0]),
        ("none", 0, 0, [1.0, 1.0]),
    ]
    tokens = spark.createDataFrame(rows, "id string, pos int, mask int, vec array<float>").repartition(4)
    mean = {r.id: r.vec for r in pooling.mean_pool(tokens).collect()}
    assert mean == {"a": [2.0, 4.0], "left": [5.0, 4.0], "none": [0.0, 0.0]}
    assert {r.id: r.vec for r in pooling.last_pool(tokens).collect()} == {"a": [3.0, 6.0], "left": [5.0, 4.0], "none": [0.0, 0.0]}


def _encoder():
    # Defined inside, so that it travels to the tasks by value.
    def factory():
        return lambda texts: np.array([[len(t), t.count("Q"), 1.0] for t in texts])

    return factory


def test_encode_corpus_uses_last_prompt(spark):
    ex = frame(
        spark,
        [
            example(0, 0, "sts", ["same", "b"], ["sentence_a", "sentence_b"], teacher=["sts_query", "document"]),
            example(0, 1, "retrieval", ["same", "doc"], ["query", "positive"], teacher=["web_search_query", "document"]),
            example(0, 2, "retrieval", ["neg", "same"], ["negative", "positive"], teacher=["sts_query", "nan"]),
            example(0, 3, "retrieval", ["None", "x"], ["query", "positive"], teacher=["None", None]),
        ],
    )
    texts = keys.distinct_texts(ex)
    chosen = encode.query_prompted_texts(ex, texts).collect()
    assert [(r.prompt_name, r.text.endswith("Query: same")) for r in chosen] == [("web_search_query", True)]
    out = encode.encode_corpus(texts, ex, _encoder(), batch_size=2)
    assert out.filter("kind = 'doc'").count() == texts.count()
    by = {(r.text_id, r.kind): r.vec for r in out.collect()}
    same = chosen[0].text_id
    raw = np.array([4.0, 0.0, 1.0])
    want = (raw / np.linalg.norm(raw)).astype(np.float32).astype(np.float16).astype(np.float32)
    assert by[(same, "doc")] == want.tolist() and by[(same, "query")] != by[(same, "doc")]


def test_packed_batches():
    rng = np.random.default_rng(0)
    for budget in (None, 50, 1000):
        lengths = rng.integers(0, 100, 300)
        batches = encode.packed(lengths, 16, budget)
        assert sorted(np.concatenate(batches).tolist()) == list(range(300))
        for places in batches:
            assert 1 <= len(places) <= 16
            assert budget is None or len(places) == 1 or len(places) * lengths[places].max() <= budget
        longest = [lengths[places].max() for places in batches]
        assert longest == sorted(longest)


@pytest.mark.parametrize("options", [{"budget": 200}, {"budget": 1, "batch_size": 3}, {"tasks": 3}, {"max_length": 40, "budget": 400}])
def test_packing_changes_no_vector_and_no_order(spark, options):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", "x" * int(rng.integers(0, 120)) + "Q" * (i % 3), "doc") for i in range(500)]
    texts = spark.createDataFrame(rows, "text_id string, text string, kind string").coalesce(1)
    plain = encode.encode(texts, _encoder()).collect()
    packed = encode.encode(texts, _encoder(), **options).collect()
    assert (sorted(packed) == sorted(plain)) if "tasks" in options else (packed == plain)


def test_padding_is_reported_and_falls(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{i}", "x" * int(n), "doc") for i, n in enumerate(rng.integers(1, 1000, 2000))]
    texts = spark.createDataFrame(rows, "text_id string, text string, kind string").coalesce(2)
    packed = encode.encode(texts, _encoder(), batch_size=32, report=True)
    n, padding = encode.padding_share(packed).first()
    in_order = np.array([len(t) for _, t, _ in rows][: 32 * 62]).reshape(-1, 32)
    as_they_come = 1 - in_order.sum() / (in_order.max(1) * 32).sum()
    assert n == 2000 and padding < 0.05 < 0.4 < as_they_come
    assert packed.filter("padded < length").count() == 0
    assert encode.padding_share(packed.limit(0)).first().padding is None


def test_a_broken_job_goes_on_with_its_unfinished_parts(spark):
    out, log = (tempfile.mkdtemp(prefix="pairforge-test-") for _ in range(2))
    rows = [(f"t{i}", f"text {i}", kind) for i in range(40) for kind in ("doc", "query")[: 1 + i % 2]]
    texts = spark.createDataFrame(rows, "text_id string, text string, kind string").repartition(3)
    broken = texts.filter(encode.in_part(4) == 2).first().text

    def factory(fails):
        def build():
            def run(some):
                if fails and broken in some:
                    raise ValueError("lost")
                for t in some:
                    open(f"{log}/{t}-{uuid.uuid4().hex}", "w").close()
                return np.array([[len(t), 1.0] for t in some])

            return run

        return build

    write = lambda fails: tables.write_embedding_parts(texts, f"{out}/e", 4, lambda some: encode.encode(some, factory(fails), batch_size=4))
    with pytest.raises(Exception, match="lost"):
        write(True)
    before = len(os.listdir(log))
    assert write(False) == [2, 3]
    finished = texts.filter(encode.in_part(4) < 2).count()
    assert before >= finished and len(os.listdir(log)) - before == texts.count() - finished
    got = tables.read_embeddings(spark, f"{out}/e")
    assert got.columns == ["text_id", "vec", "kind"] and pairs_of(got, "text_id", "kind") == sorted((t, k) for t, _, k in rows)
    assert write(False) == []
    with pytest.raises(ValueError, match="another number"):
        tables.write_embedding_parts(texts, f"{out}/e", 5, lambda some: some)


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_a_filter_denies_no_known_id(spark, n):
    ids = spark.range(n).selectExpr("concat('en_', sha1(CAST(id AS STRING))) AS text_id")
    members = membership.Membership.of(ids)
    assert ids.filter(members.may_hold()).count() == n
    others = spark.range(10_000, 30_000).selectExpr("concat('en_', sha1(CAST(id AS STRING))) AS text_id")
    assert others.filter(members.may_hold()).count() < 0.03 * 20_000
    assert spark.createDataFrame([(None,)], "text_id string").filter(members.may_hold()).count() == 0
    assert membership.Membership.of(ids, most_bits=32) is None


def test_absent_ids_are_not_shuffled(spark):
    """Of refs to 50 known and 5,000 absent ids hardly an absent one reaches an exchange; the join behind is exact."""
    emb = vectors(spark, {f"k{i}": [1, 0] for i in range(50)})
    refs = spark.range(10_000).selectExpr("id AS row", "if(id % 2 = 0, concat('k', id % 100 div 2), concat('absent', id)) AS text_id")
    members = lookup.known_ids(emb)
    plain = [sorted(r.row for r in f(refs, emb, ["row"], {}).collect()) for f in (lookup.with_vector, lookup.without_vector)]
    for find, want in zip((lookup.with_vector, lookup.without_vector), plain):
        found = find(refs, emb, ["row"], {}, members)
        assert sorted(r.row for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "BloomFilter" not in plan
    denied = refs.filter(~members.may_hold()).count()
    assert 0.95 * 5_000 < denied <= 5_000


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_lookup_overlay_and_membership(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "TARGET_ROWS", hot_rows)
    emb = vectors(spark, {"a": [1, 0], "b": [2, 0], "h": [5, 5]}).unionByName(vectors(spark, {"a": [9, 9]}, "query"))
    rows = [(i, t, q) for i, (t, q) in enumerate([("a", True), ("a", False), ("b", True), ("z", True)] + [("h", False)] * 40)]
    refs = spark.createDataFrame(rows, "row int, text_id string, q boolean")
    got = {r.row: r.vec for r in lookup.lookup_vectors(refs, emb, ["row"], use_query="q").collect()}
    assert got == {0: [9, 9], 1: [1, 0], 2: [2, 0], **{i: [5, 5] for i in range(4, 44)}}
    assert pairs_of(lookup.without_vector(refs, emb, ["row"]), "row") == [(3,)]
    assert lookup.with_vector(refs, emb, ["row"]).count() == 43
    over = {r.text_id: (r.doc_vec, r.query_vec) for r in lookup.overlay(emb).collect()}
    assert over == {"a": ([1, 0], [9, 9]), "b": ([2, 0], [2, 0]), "h": ([5, 5], [5, 5])}


def test_prompts(spark):
    from pairforge.functions.prompts import Prompts, effective_student_prompt

    p = Prompts.from_config({"prompts": {"student": {"sts": "S> "}}})
    rows = [("sts", "query"), ("document", "query"), ("unknown", "query"), (None, "query"), ("ret", "positive"),
            ("bitext", "sentence_a"), ("bitext", "sentence_b"), ("nan", "query"), ("unknown", "negative")]
    df = spark.createDataFrame(rows, "name string, role string").withColumn("t", F.lit("hello"))
    got = df.select(
        "name", "role",
        p.student_text(F.col("name"), F.col("t")).alias("s"),
        Prompts().teacher_text(F.lit("sts_query"), F.col("t")).alias("te"),
        effective_student_prompt(F.col("role"), F.col("name")).alias("e"),
    ).collect()
    assert [r.s for r in got] == ["S> hello", "hello", "hello", "hello", "ret: hello", "bitext: hello", "bitext: hello", "hello", "hello"]
    assert got[0].te == "Instruct: Retrieve semantically similar text\nQuery: hello"
    assert [r.e for r in got] == ["sts", "document", "unknown", None, "document", "bitext", "document", None, "unknown"]


def test_positions_feed_strides(spark):
    ex = frame(spark, [example(0, i, "sts", [f"t{i}"], ["query"]) for i in range(9)])
    ranks = ordering.stride(ordering.example_position(ex), 2)
    assert sorted(r["rank"] for r in ranks.collect()) == [0] * 5 + [1] * 4
