"""Filter interactions: against a loop over documents, the matrix itself, odd rows."""

import re
from collections import Counter
from itertools import permutations

import pytest

from pairforge.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def loop(rows, labels):
    """Every order applied to every document, one by one."""
    good, toxic = ({i for i, *flags in labels if i is not None and flags[k] == 1} for k in (0, 1))
    fails = []
    for i, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            f.add("C")
        if set(text) & set("#$%&*|"):
            f.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            f.add("E")
        fails.append((i, part or "", f))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[1] == part]
            for step, own in enumerate(order, 1):
                now = [x for x in left if own in x[2]]
                left = [x for x in left if own not in x[2]]
                earlier = [x for x in fails if x[1] == part and own in x[2] and x[2] & set(order[: step - 1])]
                only = [x for x in fails if x[1] == part and x[2] == {own}]
                shapley[part, own] += len(now)
                out[part, order, step] = [
                    len(left), len(now), len(earlier), len(only), sum(x[0] in good for x in now), sum(x[0] in toxic for x in now),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(frame):
    return {tuple(r)[:3]: tuple(r)[3:] for r in frame.collect()}


VARIED = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, VARIED, "en"), (2, VARIED, "en"), (2, VARIED, "en"), (2, VARIED, "de"), (None, VARIED, "en"), (None, VARIED, None),
    (3, "same " * 300, "en"), (4, "same\x0bsame\x1csame " * 300, "en"), (5, None, None), (6, "", ""), (7, " \t\n ", "fr"), (8, "AÉ", "fr"),
    (9, VARIED + " $", "de"), (9, VARIED + " ABC" * 20, "de"), (10, VARIED + " $", "en"), (11, "é" * 500 + " |", "de"),
    (12, "Same same " * 100, "en"), (-3, "", "en"), (13, "w " * 100 + " ".join(f"x{i}" for i in range(100)), "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (5, 1, None), (9, 1, 1), (None, 1, 1), (10, 0, 1), (99, 1, 1), (7, 1, 0)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_against_a_loop(spark, labels):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    assert got(A.audit(rows, labels)) == loop(ROWS, LABELS)


@pytest.mark.parametrize("shard, segment", [(1, 1), (1, 3000), (4 << 20, 32 << 20)])
def test_matrix(spark, shard, segment):
    """Each row of the matrix holds the counts of its text's words; numbers are dense and of one word each."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    matrix = A.document_term_matrix(rows, shard_bytes=shard, segment_bytes=segment)
    name = {r.word_id: r.word for r in matrix.dictionary().collect()}
    every = {w for _, t, _ in ROWS for w in WORD.findall(t or "")}
    assert sorted(name) == list(range(len(every))) and set(name.values()) == every
    seen = []
    for shard in matrix.csr().collect():
        for k, i in enumerate(shard.doc_ids):
            a, b = shard.indptr[k : k + 2]
            assert len(set(shard.indices[a:b])) == b - a
            seen.append((str(i), sorted((name[w], n) for w, n in zip(shard.indices[a:b], shard.counts[a:b]))))
    assert sorted(seen) == sorted((str(i), sorted(Counter(WORD.findall(t or "")).items())) for i, t, _ in ROWS)


def test_odd_rows(spark, odd, nothing, labels):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert got(A.audit(odd, labels)) == loop(rows, LABELS)
    assert got(A.audit(odd, labels.limit(0))) == loop(rows, [])
    assert A.audit(nothing, labels).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS lang")
    assert got(A.audit(empty, labels)) == loop([(1, None, "x"), (2, "", "x")], LABELS)
