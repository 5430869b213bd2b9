import hashlib

import pytest
from pyspark.sql import functions as F

from helpers import example, frame, pairs_of, random_examples
from pairforge.operators import keys, lookup, ordering, skew


@pytest.fixture(params=[3, 1 << 17], ids=["many-buckets", "one-bucket"])
def width(request, monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", request.param)
    return request.param


def ordered(df):
    return df.orderBy("source_seq", "row_ord").collect()


def test_text_id(spark):
    df = frame(spark, [example(0, 0, "bitext", ["héllo", "안녕"], ["sentence_a", "sentence_b"], lang="en-ko")])
    want = ["en_" + hashlib.sha1(f"en||{t}".encode()).hexdigest()[:16] for t in ("héllo", "안녕")]
    assert df.first().text_ids == want
    per_side = keys.assign_text_ids(df, per_side_lang=True).first().text_ids
    assert per_side[0] == want[0] and per_side[1].startswith("ko_")


def test_positions_match_a_global_sort(spark, width):
    ex = random_examples(spark, 150)
    want = [(r.source_seq, r.row_ord) for r in ordered(ex)]
    for parts in (1, 17):
        got = ordering.example_position(ex.repartition(parts), total="n").collect()
        assert {(r.source_seq, r.row_ord): r.pos for r in got} == {k: i for i, k in enumerate(want)}
        assert {r.n for r in got} == {150}


def test_distinct_texts_first_appearance(spark):
    ex = random_examples(spark, 80)
    want, uses = {}, {}
    for r in ordered(ex):
        for side, (t, i) in enumerate(zip(r.texts, r.text_ids)):
            want.setdefault(i, (t, r.source_seq, r.row_ord, side))
            uses[i] = uses.get(i, 0) + 1
    got = keys.distinct_texts(ex.repartition(5)).collect()
    assert {r.text_id: (r.text, r.source_seq, r.row_ord, r.side) for r in got} == want
    assert {r.text_id: r.n_uses for r in got} == uses


def test_texts_are_fetched_late(spark):
    """Ids combine in hash aggregates that hold no text; nothing is aggregated by sorting."""
    plan = keys.distinct_texts(random_examples(spark, 40))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    for line in plan.splitlines():
        assert "Aggregate" not in line or "texts" not in line


def test_last_text_of_a_shared_id_wins(spark):
    rows = [example(s, r, "sts", [f"old {s}{r}", f"new {s}{r}"], ["sentence_a", "sentence_b"]) for s in (0, 3) for r in (5, 2**40, 7)]
    same = frame(spark, rows).withColumn("text_ids", F.transform("texts", lambda t: F.lit("x")))
    got = keys.distinct_texts(same).collect()
    assert [tuple(r) for r in got] == [("x", f"new 3{2**40}", "en", 0, 5, 0, 12)]


@pytest.mark.parametrize("part, value", [("source_seq", 1 << 11), ("row_ord", 1 << 41), ("row_ord", -1), ("row_ord", None)])
def test_order_parts_beyond_their_bits_are_an_error(spark, part, value):
    ex = random_examples(spark, 3).withColumn(part, F.lit(value).cast("int" if part == "source_seq" else "long"))
    with pytest.raises(Exception, match="beyond its bits"):
        keys.text_uses(ex).collect()


@pytest.mark.parametrize("cap", [1, 7, 20, 10_000])
def test_caps(spark, width, cap, monkeypatch):
    monkeypatch.setattr(skew, "TARGET_ROWS", 5)
    ex = random_examples(spark, 120, seed=cap)
    order = list(dict.fromkeys(i for r in ordered(ex) for i in r.text_ids))
    keep = set(order[:cap])
    texts = keys.distinct_texts(ex)
    assert {r.text_id for r in keys.cap_texts(texts, cap).collect()} == keep
    want = [(r.source_seq, r.row_ord) for r in ordered(ex) if keep.issuperset(r.text_ids)]
    assert pairs_of(keys.cap_examples(ex, texts, cap), "source_seq", "row_ord") == want


@pytest.mark.parametrize("n, held", [(99, 0), (100, 1), (250, 2)])
def test_holdout_and_shards(spark, width, n, held):
    ex = random_examples(spark, n)
    got = ordering.assign_shards(ordering.split_holdout(ex), 40)
    rows = {(r.source_seq, r.row_ord): (r.split, r.pos, r.shard) for r in got.collect()}
    for i, r in enumerate(ordered(ex)):
        split, pos = ("val", i) if i < held else ("train", i - held)
        assert rows[(r.source_seq, r.row_ord)] == (split, pos, pos // 40)


def test_stride_and_first_rows(spark, width):
    ex = random_examples(spark, 30)
    dealt = ordering.stride(ordering.example_position(ex), 4)
    assert all(r["rank"] == r.pos % 4 for r in dealt.collect())
    first = [(r.source_seq, r.row_ord) for r in ordered(ex)][:6]
    assert pairs_of(ordering.first_rows(ex, 6), "source_seq", "row_ord") == first


def test_row_numbers(spark):
    ids = keys.distinct_texts(random_examples(spark, 60)).select("text_id")
    got = {r.text_id: r.row for r in lookup.row_numbers(ids).collect()}
    assert got == {t: i for i, t in enumerate(sorted(got))}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "TARGET_ROWS", 10)
    left = spark.range(300).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    ).unionByName(spark.createDataFrame([(900, None)], "row long, k string"))
    right = left.select("k").distinct().filter("k is null or k != 'k7'").withColumn("v", F.length("k"))
    assert skew.hot_keys_of(left, "k") == {"hot": 10}
    want = left.join(right, "k", how)
    got = skew.skew_join(left, right, "k", how, ["row"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_rows_are_spread(spark):
    plan = skew.Salting("k", {"hot": 8})
    left = plan.left(spark.range(800).withColumn("k", F.lit("hot")), ["id"])
    sizes = [r["count"] for r in left.groupBy("_salt").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200
    assert plan.right(spark.createDataFrame([("hot",), ("x",)], "k string")).count() == 9


def test_every_hot_key_is_split_by_its_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "TARGET_ROWS", 10)
    rows = spark.range(2000 * 30).select((F.col("id") % 2000).alias("k"), F.col("id").alias("row"))
    rows = rows.unionByName(spark.range(400).select(F.lit(7).cast("long").alias("k"), (F.col("id") + 10**6).alias("row")))
    hot = skew.hot_keys_of(rows, "k")
    assert len(hot) == 2000 and hot[7] == 43 and hot[8] == 3
    largest = skew.Salting("k", hot).left(rows, ["row"]).groupBy("k", "_salt").count().agg(F.max("count")).first()[0]
    assert largest <= 30
