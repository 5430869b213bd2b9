from pyspark.sql import functions as F, types as T

from pairforge.functions.text import WHITESPACE, not_blank, strip
from pairforge.operators import normalize as N


def rows(df):
    return [r.asDict() for r in df.orderBy("row_ord").collect()]


def test_strip_equals_python_on_every_code_point(spark):
    chars = [(chr(c), f"{chr(c)}a{chr(c)}b{chr(c)}") for c in range(1, 0x3100)]
    df = spark.createDataFrame(chars, "c string, t string")
    got = {r.c: (r.s, r.nb) for r in df.select("c", strip(F.col("t")).alias("s"), not_blank(F.col("c")).alias("nb")).collect()}
    for c, text in chars:
        assert got[c] == (text.strip(), bool(c.strip())), hex(ord(c))
    assert len(WHITESPACE) == 29


def test_sts_columns_scores_and_blanks(spark):
    schema = "row_ord long, sentence_a string, sentence_b string, text1 string, label float, similarity double"
    df = spark.createDataFrame(
        [
            (0, " a　", "b", "x", 3.0, 9.0),
            (1, " \x1f", "b", "x", 1.0, 9.0),
            (2, None, "b", "x", 1.0, 9.0),
            (3, "a", "b", "x", float("nan"), 9.0),
            (4, "a", "b", "x", None, 9.0),
        ],
        schema,
    )
    out = rows(N.normalize_sts(df, "ko", "team_data", 5))
    assert [r["example_id"] for r in out] == ["sts-ko-team_data-0", "sts-ko-team_data-3", "sts-ko-team_data-4"]
    assert out[0]["texts"] == ["a", "b"] and out[0]["label"] == 3.0 and out[0]["source_seq"] == 5
    assert out[1]["label"] is None and out[2]["label"] is None
    assert out[0]["roles"] == ["sentence_a", "sentence_b"]
    assert out[0]["teacher_prompt_names"] == ["sts_query", "document"]
    assert out[0]["student_prompt_names"] == ["sts", "document"]


def test_unknown_columns_are_skipped(spark):
    df = spark.createDataFrame([(0, 1)], "row_ord long, n int")
    assert N.normalize_sts(df, "en", "x") is None
    assert N.normalize_triples(df) is None
    assert N.normalize_passages(df, "en") is None
    assert N.normalize_answers(df, "en") is None
    assert N.normalize_bitext(df, "en-ko") is None


def test_triples_keep_spaces_and_cap_before_dropping_blanks(spark):
    df = spark.createDataFrame(
        [
            (0, " q ", [" p ", "other"], ["", "n1 ", " ", "n2"]),
            (1, "q", [], ["n"]),
            (2, "q", [" "], ["n"]),
            (3, " ", ["p"], ["n"]),
            (4, "q", ["p"], None),
            (5, "q", None, ["n"]),
            (6, "q", ["p"], [None, "n"]),
        ],
        "row_ord long, query string, positive array<string>, negative array<string>",
    )
    out = {r["row_ord"]: r for r in rows(N.normalize_triples(df, 3))}
    assert sorted(out) == [0, 4, 6]
    assert out[0]["texts"] == ["q", " p ", "n1 "]
    assert out[0]["roles"] == ["query", "positive", "negative"]
    assert out[0]["student_prompt_names"] == ["ret", "document", "document"]
    assert out[4]["texts"] == ["q", "p"] and out[6]["texts"] == ["q", "p", "n"]
    assert out[0]["example_id"] == "ret-en-msmarco-0" and out[0]["lang"] == "en"


def test_triples_scalar_columns(spark):
    df = spark.createDataFrame(
        [(0, "q", "p", "n"), (1, "q", "p", " "), (2, "q", " ", "n"), (3, "q", "p", None)],
        "row_ord long, query string, pos string, neg string",
    )
    out = {r["row_ord"]: r["texts"] for r in rows(N.normalize_triples(df, 3))}
    assert out == {0: ["q", "p", "n"], 1: ["q", "p"], 3: ["q", "p"]}
    assert N.normalize_triples(df.drop("pos")) is None


def test_passages_drop_blanks_before_the_cap(spark):
    p = T.StructType().add("text", "string").add("passage", "string")
    schema = (
        T.StructType().add("row_ord", "long").add("query", "string")
        .add("positive_passages", T.ArrayType(p)).add("negative_passages", T.ArrayType(p))
    )
    df = spark.createDataFrame(
        [
            (0, "q", [(None, " p "), ("x", None)], [("", ""), ("n1", None), (" ", "z"), ("", "n2"), ("n3", None)]),
            (1, "q", [("", None), ("p", None)], [("n", None)]),
            (2, "q", [], [("n", None)]),
            (3, "q", [("p", None)], None),
        ],
        schema,
    )
    out = {r["row_ord"]: r for r in rows(N.normalize_passages(df, "ko", 2))}
    # Only the first positive counts; a whitespace-only text field hides the other field.
    assert sorted(out) == [0, 3]
    assert out[0]["texts"] == ["q", "p", "n1", "n2"] and out[0]["example_id"] == "ret-ko-miracl-0"
    assert out[3]["texts"] == ["q", "p"]


def test_passages_of_strings_and_wrong_shapes(spark):
    df = spark.createDataFrame(
        [(0, "q", [" p "], [" ", "n"])], "row_ord long, query string, positive array<string>, negative array<string>"
    )
    assert rows(N.normalize_passages(df, "en"))[0]["texts"] == ["q", "p", "n"]
    scalar = spark.createDataFrame([(0, "q", "p")], "row_ord long, query string, positive string")
    assert rows(N.normalize_passages(scalar, "en")) == []
    only = spark.createDataFrame([(0, "q", [("t",)])], "row_ord long, query string, positive array<struct<passage:string>>")
    assert rows(N.normalize_passages(only, "en"))[0]["texts"] == ["q", "t"]


def test_answers_from_list_struct_and_string(spark):
    lists = spark.createDataFrame(
        [(0, "q", [" a ", "b"]), (1, "q", []), (2, "q", None), (3, "q", [None]), (4, " ", ["a"])],
        "row_ord long, question string, answers array<string>",
    )
    assert [r["texts"] for r in rows(N.normalize_answers(lists, "ko"))] == [["q", "a"]]
    structs = spark.createDataFrame(
        [(0, "q", [("t",)]), (1, "q", [(None,)])],
        "row_ord long, query string, positive_passages array<struct<text:string>>",
    )
    assert [r["texts"] for r in rows(N.normalize_answers(structs, "ko"))] == [["q", "t"]]
    one = spark.createDataFrame([(0, "q", ("t",))], "row_ord long, query string, positive_passage struct<text:string>")
    assert rows(N.normalize_answers(one, "ko"))[0]["example_id"] == "ret-ko-mrtydi-0"
    plain = spark.createDataFrame([(0, "q", "a")], "row_ord long, query string, answers string")
    assert rows(N.normalize_answers(plain, "ko"))[0]["texts"] == ["q", "a"]


def test_bitext_aliases_and_first_string_columns(spark):
    known = spark.createDataFrame([(0, "x", "k", "e")], "row_ord long, zz string, ko string, en string")
    assert rows(N.normalize_bitext(known, "en-ko"))[0]["texts"] == ["e", "k"]
    unknown = spark.createDataFrame([(0, 1, "l", "r", "s")], "row_ord long, n int, left string, right string, s string")
    out = rows(N.normalize_bitext(unknown, "en-ko"))[0]
    assert out["texts"] == ["l", "r"] and out["teacher_prompt_names"] == ["bitext_query"] * 2


def test_router(spark):
    df = spark.createDataFrame([(0, "q", ["p"])], "row_ord long, query string, positive array<string>")
    route = lambda name: rows(N.normalize_source(df, "retrieval", name, "ko"))[0]["example_id"]
    assert route("a/msmarco-x") == "ret-en-msmarco-0"
    assert route("miracl/miracl") == "ret-ko-miracl-0"
    assert route("other/set") == "ret-ko-miracl-0"
    answers = df.withColumnRenamed("positive", "answers")
    assert rows(N.normalize_source(answers, "retrieval", "x/mr_tydi", "ko"))[0]["example_id"] == "ret-ko-mrtydi-0"
