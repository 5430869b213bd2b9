import pytest
from pyspark.errors import PySparkException

from helpers import example, frame, pairs_of
from pairforge.operators import validate as V

GOOD = example(0, 0, "sts", ["a", "b"], ["sentence_a", "sentence_b"], 3.0)
BAD = {
    "invalid_task": example(0, 1, "other", ["a"], ["query"]),
    "empty_texts": example(0, 2, "sts", [], []),
    "unequal_lengths": example(0, 3, "sts", ["a", "b"], ["query"]),
    "invalid_role": example(0, 4, "sts", ["a"], ["narrator"]),
    "blank_text": example(0, 5, "sts", ["a", " 　"], ["query", "positive"]),
}


def test_one_bad_record_per_rule(spark):
    df = frame(spark, [GOOD, *BAD.values()], ids=False)
    got = {r.row_ord: r.error for r in V.annotate(df).collect()}
    assert got == {0: None, **{row[1]: error for error, row in BAD.items()}}


def test_nulls_are_faults(spark):
    null_text = example(0, 1, "sts", ["a", None], ["query", "positive"])
    null_texts = example(0, 2, "sts", None, ["query"])
    null_role = example(0, 3, "sts", ["a"], [None])
    null_task = example(0, 4, None, ["a"], ["query"])
    df = frame(spark, [null_text, null_texts, null_role, null_task], ids=False)
    assert pairs_of(V.annotate(df), "row_ord", "error") == [
        (1, "blank_text"), (2, "empty_texts"), (3, "invalid_role"), (4, "invalid_task"),
    ]


def test_first_rule_wins_and_counts(spark):
    both = example(0, 6, "other", [], ["narrator"])
    df = frame(spark, [GOOD, both], ids=False)
    assert pairs_of(V.error_counts(df), "error", "n") == [("invalid_task", 1), ("ok", 1)]


def test_missing_column_and_defaults(spark):
    df = frame(spark, [GOOD], ids=False)
    assert V.annotate(df.drop("lang")).first().error == "missing_field:lang"
    good, bad = V.quarantine(df.drop("label", "text_ids"))
    row = good.first()
    assert row.label is None and row.text_ids is None and bad.count() == 0
    assert dict(good.dtypes)["text_ids"] == "array<string>"


def test_fail_mode(spark):
    assert V.require_valid(frame(spark, [GOOD], ids=False)).count() == 1
    with pytest.raises(PySparkException, match="blank_text"):
        V.require_valid(frame(spark, [GOOD, BAD["blank_text"]], ids=False)).collect()
