"""Substring and byte de-duplication, near-duplicates: brute force and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairforge.llm import byte_dedup, decontaminate, minhash_dedup, substring_dedup
from pairforge.llm.components import components
from pairforge.llm.queries import QUERIES
from pairforge.llm.run_index import longest_matches

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def cut_words(docs):
    first, words = {}, [(i, t.split()) for i, t in docs]
    for i, w in sorted(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def cut_bytes(docs):
    seen = Counter(b[p : p + 200] for _, b in docs for p in range(len(b) - 199))
    out = []
    for i, b in docs:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def tangled(spark):
    """Few words and much repetition: repeats inside texts, chains, shared edges, ties."""
    rng, docs = random.Random(7), []
    for i in range(60):
        pool = WORDS[: rng.choice((2, 3, 19))]
        text = [rng.choice(pool) for _ in range(rng.randint(0, 120))]
        if docs and i % 3:
            old = rng.choice(docs)[1].split()
            a = rng.randint(0, len(old))
            text[rng.randint(0, len(text)) :] = old[a : a + rng.randint(5, 80)]
        docs.append((i, " ".join(text)))
    return docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def test_substrings_of_tangled_texts(tangled):
    docs, df = tangled
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(df).collect())
    assert got == cut_words(docs)


def test_bytes_of_tangled_texts(tangled):
    docs, df = tangled
    got = byte_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", byte_dedup.kept_digest())
    assert sorted(tuple(r) for r in got.collect()) == cut_bytes([(i, t.encode()) for i, t in docs])


def test_bytes_of_the_table(spark, texts):
    got = QUERIES["op6_byte_dedup"](spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == cut_bytes([(i, t.encode()) for i, t in texts])


@pytest.mark.parametrize("length", [100, 120, 150, 199])
def test_hot_anchors_are_split(spark, monkeypatch, length):
    """A passage in all documents, some with equal surroundings: brute force, without and with splits.

    The least bounds leave single windows of what the sides have in common.
    """
    rng = random.Random(length)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, near = line(length), [line(110) for _ in range(4)]
    docs = []
    for i in range(60):
        before = line(60) + rng.choice(near) if i % 3 == 0 else line(170)
        after = rng.choice(near) + line(60) if i % 5 == 0 else line(170)
        docs.append((i, before + passage + after))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = cut_bytes([(i, t.encode()) for i, t in docs])
    assert sum(r[2] for r in want) > 0
    for size in (1 << 19, 2000, 300):
        monkeypatch.setattr(byte_dedup, "INDEX_BYTES", size)
        got = byte_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", byte_dedup.kept_digest())
        assert sorted(tuple(r) for r in got.collect()) == want


def test_hot_anchors_are_those_beyond_an_index(spark):
    mark = 1 << byte_dedup._COUNT_BITS | 101  # contexts of 300 bytes
    n = byte_dedup.INDEX_BYTES // 300
    met = spark.range(2 * n + 1).select(F.when(F.col("id") < n, 1).otherwise(2).alias("anchor"), F.array(F.lit(mark)).alias("marks"), F.lit(True).alias("indexed"))
    assert [r.anchor for r in byte_dedup.hot_anchors(met).collect()] == [2]


def test_odd_rows_of_substrings(odd, nothing):
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(odd).select("doc_id", "n_words", "n_removed").collect())
    assert got[1, 15, 0] == 2 and got[2, 15, 15] == 1 and got[None, 15, 0] == 1
    assert got[3, 0, 0] == got[4, 0, 0] == got[5, 0, 0] == got[None, 0, 0] == 1 and got[6, 60_000, 0] == 1
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    df = spark.createDataFrame([(1, a), (2, f"{a} {b}"), (2, f"{c} {c}")], "doc_id long, text string")
    got = {r.kept_text: r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {a: 0, b: 40, f"{c} {c}": 0}


def unlike(n, seed, size=40):
    rng = random.Random(seed)
    return [" ".join(f"{rng.getrandbits(32):x}" for _ in range(size)) for _ in range(n)]


@pytest.mark.parametrize("shared", [7, None])
def test_many_texts_of_one_id(spark, shared):
    """15,000 different texts under one id, or without any, and 100 that stand twice: those alone are cut."""
    alone, twice = unlike(15_000, 1), unlike(100, 2)
    if shared is not None:
        rows = [(1, t) for t in twice] + [(shared, t) for t in alone + twice]
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert sorted((r.doc_id, r.kept_text) for r in got.filter("n_removed > 0").collect()) == [(shared, "")] * 100
        assert got.count() == len(rows)
    rows = [(shared, t) for t in alone + twice + twice]
    got = byte_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((r.n_bytes, r.n_removed) for r in got.filter("n_removed > 0").collect()) == sorted((len(t), len(t)) for t in twice + twice)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {shared}


def test_one_row_repeated_many_times(spark):
    """Marks of equal rows are one set, however many rows there are."""
    text = unlike(1, 3)[0]
    df = spark.range(5_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(7)
    df = df.unionByName(spark.createDataFrame([(1, text)], df.schema))
    assert byte_dedup.remove_repeats(df).filter("n_removed = n_bytes").count() == 5_001
    assert substring_dedup.remove_repeats(df).groupBy("doc_id", "n_removed").count().orderBy("doc_id").collect() == [(1, 0, 1), (3, 40, 5_000)]


def thue_morse(n, flip):
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


def test_long_words_made_to_collide(spark):
    """Words of 1,024 letters and their complements have one polynomial hash modulo 2^64 for any odd base."""
    words = [[thue_morse(1024, flip) + c for c in "abcdefghijklm"] for flip in (0, 1)]
    df = spark.createDataFrame([(i + 1, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    groups = minhash_dedup.near_duplicates(df).orderBy("doc_id").collect()
    assert [(r.component_id, r.n_shingles) for r in groups] == [(1, 9), (2, 9)]
    items = spark.createDataFrame([("x", " ".join(words[0]))], "item_id string, text string")
    found = {r.doc_id: r.found.n_hit for r in decontaminate.find_benchmark(df, items).collect()}
    assert found == {1: 13, 2: 0}
    upper = spark.createDataFrame([(1, " ".join(words[0]).upper())], "doc_id long, text string")
    assert decontaminate.find_benchmark(upper, items).first().found.n_hit == 13


def test_odd_rows_of_bytes(odd, nothing):
    got = Counter(tuple(r) for r in byte_dedup.remove_repeats(odd).select("doc_id", "n_bytes", "n_removed").collect())
    assert got[3, 0, 0] == got[4, 0, 0] == got[None, 0, 0] == 1 and got[1, 88, 0] == 2
    assert byte_dedup.remove_repeats(nothing).count() == 0


def test_longest_matches_by_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        data, starts = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
        if not len(data):
            continue
        places = [(i, j) for i, p in enumerate(parts) for j in range(len(p))]
        common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        want = [max((common(parts[i][j:], parts[p][q:]) for p, q in places if (p, q) != (i, j)), default=0) for i, j in places]
        assert longest_matches(data, starts).tolist() == want


def groups_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()}


def brute_groups(docs):
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_chains_and_stars_of_near_duplicates(spark):
    """Groups whose links do not run over the smallest document, close to the threshold on both sides."""
    rng, docs = random.Random(5), []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((6, 40, 150)))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(docs)
    assert groups_of(spark.createDataFrame(docs, "doc_id long, text string")) == brute_groups(docs)


def test_odd_rows_of_near_duplicates(odd, nothing):
    rows = minhash_dedup.near_duplicates(odd).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert len(rows) == odd.count() and got[1] == (11, 1, True) and got[2] == (11, 1, False)
    assert got[3] == (0, 3, True) and got[5] == (0, 5, True) and got[8] == (1, 8, True)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert minhash_dedup.near_duplicates(nothing).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (1, 3), (3, 1), (2, 2), (None, 4), (10, 3)], "a long, b long")
    got = dict(tuple(r) for r in components(links).collect())
    assert got == {5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 1: 1, 3: 1, 10: 1}
    assert components(links.filter(F.lit(False))).count() == 0


def family(n, common, own, seed=5):
    """Texts whose shingle sets share about ``common`` and have ``own`` more each."""
    rng = random.Random(seed)
    base = [f"c{rng.randrange(10**9)}" for _ in range(common)]
    return [(i, " ".join(base + [f"d{i}x{rng.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


def test_large_sets_below_the_threshold_are_told_apart_by_sketch():
    """Pairwise similarity 0.70 of 3,400 shingles is no candidate, 0.76 is."""
    passed = []
    for own in (600, 440):
        docs = family(40, 2800, own)
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
        signed = pa.Table.from_batches(list(minhash_dedup.sign(iter([batch])))).combine_chunks()
        sizes, bins = np.asarray(signed["n_shingles"]), signed["bins"].combine_chunks()
        width, levels = minhash_dedup._levels(bins)
        a, b = np.triu_indices(len(docs), 1)
        w = int(width[0])
        passed.append(minhash_dedup.likely(levels[w][a], sizes[a], levels[w][b], sizes[b]).mean())
    assert passed[0] < 0.05 and passed[1] == 1


def test_no_task_holds_a_large_bucket(spark):
    """One set beside a large component, and a bucket of loose sets: meetings of two blocks at most."""
    n = 3 * minhash_dedup.BLOCK_SETS
    ids = spark.range(n).select(F.col("id").alias("rep"))
    near = ids.select(F.lit(1).alias("bucket"), "rep", F.when(F.col("rep") == 7, 7).otherwise(0).alias("component"))
    loose = ids.select(F.lit(2).alias("bucket"), "rep", F.col("rep").alias("component"))
    sizes = minhash_dedup._dealt(near.unionByName(loose)).groupBy("bucket", "x", "y").count().collect()
    assert len(sizes) == 4 + 9 and max(r["count"] for r in sizes) < 2.2 * minhash_dedup.BLOCK_SETS


def test_blocks_of_a_bucket_find_what_one_block_finds(spark, monkeypatch):
    """Blocks of three sets give the groups of brute force."""
    rng, docs = random.Random(11), family(1, 60, 0)
    for i in range(1, 40):
        words = rng.choice(docs)[1].split()
        for _ in range(rng.choice((2, 3, 5))):
            words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(minhash_dedup, "BLOCK_SETS", 3)
    assert groups_of(df) == brute_groups(docs)


def test_first_shared_table_is_told_by_whole_hashes():
    """Collection 0 agrees in the low halves of its hashes only: the table of 1 and 2 is the first one shared."""
    one = np.arange(minhash_dedup._N, dtype=np.uint32)
    two = one.copy()
    two[: minhash_dedup.HASHES] += np.uint32(1 << 16)
    bins = bytes([0x11]) * (minhash_dedup.BINS // 2)
    names = ["bucket", "x", "y", "own", "i", "j", "rep", "component", "n_shingles", "signature", "bins"]
    columns = [[5, 5], [0, 0], [0, 0], [0, 0], [1, 1], [2, 2], [3, 4], [3, 4], [600, 600], [one.tobytes(), two.tobytes()], [bins, bins]]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)
    assert [b.to_pylist() for b in minhash_dedup._bucket_pairs(iter([batch]))] == [[{"a": 4, "b": 3}]]
