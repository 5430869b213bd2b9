"""Normalisers: differently shaped source tables to the one example schema.

Columns are resolved at plan-build time from ``df.schema``.  A source whose
columns are not recognised gives ``None``: the caller skips it.  Each frame
must carry ``row_ord``, the row's position in its source.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairforge import constants as K
from pairforge.functions.text import as_column, not_blank, passage_text, strip
from pairforge.schemas import EXAMPLE

DOC = "document"


def pick_pair(columns: Iterable[str], variants: Sequence[tuple[str, str]]) -> tuple[str, str] | None:
    """First alias pair that is fully present."""
    have = set(columns)
    return next((pair for pair in variants if have.issuperset(pair)), None)


def pick_column(columns: Iterable[str], aliases: Sequence[str]) -> str | None:
    have = set(columns)
    return next((name for name in aliases if name in have), None)


def clean_label(label: Column) -> Column:
    """Numeric label; NaN means unlabelled and becomes null."""
    number = label.cast("double")
    return F.when(~F.isnan(number), number)


def example_columns(
    source_seq: int,
    example_id: Column,
    task: str,
    lang: str | Column,
    texts: Column,
    roles: Column,
    teacher: Column,
    student: Column,
    label: Column | None = None,
    text_ids: Column | None = None,
) -> list[Column]:
    """Projection to the declared example schema."""
    values = {
        "source_seq": F.lit(source_seq),
        "row_ord": F.col("row_ord"),
        "example_id": example_id,
        "task": F.lit(task),
        "lang": as_column(lang),
        "texts": texts,
        "roles": roles,
        "teacher_prompt_names": teacher,
        "student_prompt_names": student,
        "label": F.lit(None) if label is None else label,
        "text_ids": F.lit(None) if text_ids is None else text_ids,
    }
    return [values[f.name].cast(f.dataType).alias(f.name) for f in EXAMPLE.fields]


def _words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _key(*parts: str | Column) -> Column:
    return F.concat_ws("-", *[as_column(p) for p in parts], F.col("row_ord"))


def _is_list(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def _passages(df: DataFrame, name: str | None) -> Column:
    """List of passage texts; anything that is not a list holds no passage."""
    if name is None or not _is_list(df, name):
        return F.array().cast("array<string>")
    element = df.schema[name].dataType.elementType
    if not isinstance(element, T.StructType):
        return F.transform(F.col(name), lambda p: strip(p.cast("string")))
    have = set(element.fieldNames())

    def text_of(p: Column) -> Column:
        if {"text", "passage"} <= have:
            return strip(passage_text(p))
        field = pick_column(have, ("text", "passage"))
        return strip(p[field]) if field else F.lit("")

    return F.transform(F.col(name), text_of)


def _query_list(query: Column, positive: Column, negatives: Column) -> dict[str, Column]:
    """Parallel lists of a query, one positive and any number of negatives."""
    n_neg = F.size(negatives)
    n_docs = n_neg + 1
    return {
        "texts": F.concat(F.array(query, positive), negatives),
        "roles": F.concat(_words("query", "positive"), F.array_repeat(F.lit("negative"), n_neg)),
        "teacher": F.concat(_words("web_search_query"), F.array_repeat(F.lit(DOC), n_docs)),
        "student": F.concat(_words("ret"), F.array_repeat(F.lit(DOC), n_docs)),
    }


def normalize_sts(df: DataFrame, lang: str | Column, name: str, source_seq: int = 0) -> DataFrame | None:
    """Sentence pairs with an optional graded label."""
    pair = pick_pair(df.columns, K.STS_PAIR_ALIASES)
    if pair is None:
        return None
    a, b = (F.col(c).cast("string") for c in pair)
    score = pick_column(df.columns, K.STS_SCORE_ALIASES)
    return df.filter(not_blank(a) & not_blank(b)).select(
        *example_columns(
            source_seq,
            _key("sts", lang, name),
            "sts",
            lang,
            F.array(strip(a), strip(b)),
            _words("sentence_a", "sentence_b"),
            _words("sts_query", DOC),
            _words("sts", DOC),
            label=clean_label(F.col(score)) if score else None,
        )
    )


def normalize_triples(
    df: DataFrame, max_negatives: int = K.DEFAULT_MAX_NEGATIVES, source_seq: int = 0
) -> DataFrame | None:
    """Query, positive and negatives as strings or lists; English.

    Passages keep their surrounding whitespace.  The cap on negatives is taken
    first and blank ones are dropped afterwards.
    """
    positive = pick_column(df.columns, K.TRIPLE_POSITIVE_ALIASES)
    if "query" not in df.columns or positive is None:
        return None
    negative = pick_column(df.columns, K.TRIPLE_NEGATIVE_ALIASES)
    query = F.col("query").cast("string")
    if _is_list(df, positive):
        pos = F.get(F.col(positive), F.lit(0)).cast("string")
    else:
        pos = F.col(positive).cast("string")
    no_texts = F.array().cast("array<string>")
    if negative is None:
        negs = no_texts
    elif _is_list(df, negative):
        negs = F.slice(F.col(negative).cast("array<string>"), 1, max_negatives)
    else:
        negs = F.array(F.col(negative).cast("string"))
    negs = F.filter(F.coalesce(negs, no_texts), not_blank)
    kept = df.filter(not_blank(query) & not_blank(pos)).select(
        "row_ord", strip(query).alias("_q"), pos.alias("_p"), negs.alias("_n")
    )
    lists = _query_list(F.col("_q"), F.col("_p"), F.col("_n"))
    return kept.select(
        *example_columns(source_seq, _key("ret", "en", "msmarco"), "retrieval", "en", **lists)
    )


def normalize_passages(
    df: DataFrame,
    lang: str | Column,
    max_negatives: int = K.DEFAULT_MAX_NEGATIVES,
    source_seq: int = 0,
) -> DataFrame | None:
    """Query with passage lists: the first positive, and the first non-blank negatives up to the cap."""
    if "query" not in df.columns:
        return None
    query = F.col("query").cast("string")
    positives = _passages(df, pick_column(df.columns, K.PASSAGE_POSITIVE_ALIASES))
    negatives = _passages(df, pick_column(df.columns, K.PASSAGE_NEGATIVE_ALIASES))
    kept = df.filter(not_blank(query)).select(
        "row_ord",
        as_column(lang).alias("_lang"),
        strip(query).alias("_q"),
        F.get(positives, F.lit(0)).alias("_p"),
        F.slice(
            F.filter(F.coalesce(negatives, F.array().cast("array<string>")), lambda t: F.length(t) > 0),
            1,
            max_negatives,
        ).alias("_n"),
    )
    lists = _query_list(F.col("_q"), F.col("_p"), F.col("_n"))
    return kept.filter(F.length("_p") > 0).select(
        *example_columns(
            source_seq, _key("ret", F.col("_lang"), "miracl"), "retrieval", F.col("_lang"), **lists
        )
    )


def _answer(df: DataFrame, name: str) -> Column:
    """The answer text of a list (its first element), a struct or a plain column."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.ArrayType):
        kind, value = kind.elementType, F.get(value, F.lit(0))
    if isinstance(kind, T.StructType):
        return value["text"] if "text" in kind.fieldNames() else F.lit(None).cast("string")
    return value.cast("string")


def normalize_answers(df: DataFrame, lang: str | Column, source_seq: int = 0) -> DataFrame | None:
    """Question with one answer taken from a list, a struct or a string."""
    question = pick_column(df.columns, K.QA_QUERY_ALIASES)
    if question is None:
        return None
    positive = pick_column(df.columns, K.QA_POSITIVE_ALIASES)
    q = F.col(question).cast("string")
    p = _answer(df, positive) if positive else F.lit(None).cast("string")
    return df.filter(not_blank(q) & not_blank(p)).select(
        *example_columns(
            source_seq,
            _key("ret", lang, "mrtydi"),
            "retrieval",
            lang,
            F.array(strip(q), strip(p)),
            _words("query", "positive"),
            _words("web_search_query", DOC),
            _words("ret", DOC),
        )
    )


def normalize_bitext(df: DataFrame, lang: str | Column, source_seq: int = 0) -> DataFrame | None:
    """Parallel sentences; without known names the first two string columns are the pair."""
    pair = pick_pair(df.columns, K.BITEXT_PAIR_ALIASES)
    if pair is None:
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if len(strings) < 2:
            return None
        pair = (strings[0], strings[1])
    a, b = (F.col(c).cast("string") for c in pair)
    return df.filter(not_blank(a) & not_blank(b)).select(
        *example_columns(
            source_seq,
            _key("bitext", lang),
            "bitext",
            lang,
            F.array(strip(a), strip(b)),
            _words("sentence_a", "sentence_b"),
            _words("bitext_query", "bitext_query"),
            _words("bitext", "bitext"),
        )
    )


def normalize_source(
    df: DataFrame,
    group: str,
    name: str,
    lang: str | Column,
    max_negatives: int | None = None,
    source_seq: int = 0,
) -> DataFrame | None:
    """Route a source to its normaliser by group and, for retrieval, by name."""
    cap = K.DEFAULT_MAX_NEGATIVES if max_negatives is None else max_negatives
    if group == "sts":
        return normalize_sts(df, lang, name.replace("/", "_"), source_seq)
    if group == "bitext":
        return normalize_bitext(df, lang, source_seq)
    if group != "retrieval":
        raise ValueError(f"unknown source group: {group}")
    if "msmarco" in name:
        return normalize_triples(df, cap, source_seq)
    has_answers = "mr-tydi" in name or "mr_tydi" in name
    if has_answers and "miracl" not in name:
        return normalize_answers(df, lang, source_seq)
    return normalize_passages(df, lang, cap, source_seq)
