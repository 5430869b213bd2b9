"""Personal data by candidate boosting, in DataFrame functions only.

1. Generators propose spans with high recall; spans of different generators
   may overlap.  Four of them are exact rules (``email``, ``ip``, ``card``,
   ``phone``); what they accept is always redacted.
2. The others propose what the rules miss: digit groups, phone-like groups
   without a plus, and long keys.  Format and context of each candidate become
   small integer features.
3. Boosted trees learn from weak labels: digit groups with a right check digit,
   groups inside an accepted phone, keys after a word like ``token``.  What
   defines a label is no feature.
4. Every candidate is judged by trees fitted on the other parts of the texts (by
   hash), and each kind gets the lowest threshold from which on the judged ones
   reach ``PRECISION``, smoothed, so that a handful of sure ones is enough in a
   small table; candidates above it, and over no other selected span, are added.

Candidates of each text are written once; they are few.  Texts are never
shuffled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pairforge.llm import boosting
from pairforge.llm.inputs import bound, fresh, or_empty
from pairforge.session import stage

PRECISION = 0.9
#: Parts of the texts by hash; trees that judge one are fitted on the others.
FOLDS = 4
#: Matches whose offsets are summed at once.
CHUNK = 256
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("card", "phone", "secret")

#: Fixed patterns of the four rules, with possessive repeats and starts at the edge of a run, so that no run is
#: tried from each of its characters.  They match what the plain forms match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates.
LOCAL_PHONE = r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])"
KEY = r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+"

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
KEY_WORD = r"(?i)(?:token|secret|passw|api.?key|auth)[a-z_]*\W{0,8}$"
PHONE_WORD = r"(?i)(?:tel|phone|call|mobile|fax|fon)\W"
CARD_WORD = r"(?i)(?:card|visa|account|iban|credit)\W"

FEATURES = ["kind", "digits", "groups", "length", "letters", "left", "right", "word"]


def _running(steps: Column) -> Column:
    """Running sums of an array of ints.

    Appending to an array in a fold copies it, so the array is summed in chunks, then
    the chunks: the cost is that of the chunk size, not of the array's.
    """
    sums = lambda values: F.slice(
        F.aggregate(values, F.array(F.lit(0)), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n))), 2, F.greatest(F.size(values), F.lit(1))
    )
    numbers = lambda values: F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(CHUNK)).cast("int"))
    inside = lambda values: F.transform(numbers(values), lambda c: sums(F.slice(values, c * CHUNK + 1, F.lit(CHUNK))))
    before = lambda parts: sums(F.concat(F.array(F.lit(0)), F.transform(parts, lambda ends: F.element_at(ends, -1))))
    joined = lambda parts: F.flatten(
        F.zip_with(parts, F.slice(before(parts), 1, F.size(parts)), lambda ends, n: F.transform(ends, lambda e: e + n))
    )
    return bound(steps, lambda values: F.when(F.size(values) <= CHUNK, sums(values)).otherwise(bound(inside(values), joined)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), code points, end exclusive."""
    # Pieces between matches and the matches themselves alternate; their running lengths are the offsets.
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, hit: F.length(gap) + F.length(hit))
    out = F.zip_with(
        found,
        _running(steps),
        lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("value")),
    )
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")
    return F.when(text.rlike(pattern), out).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` end in their right check digit."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    figure = lambda x: x.cast("int")
    figures = F.split(F.reverse(_digits(value)), "")
    parts = F.transform(figures, lambda x, i: F.when(i % 2 == 0, figure(x)).otherwise(doubled(figure(x))))
    return F.aggregate(parts, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def _count_between(value: Column, low: int, high: int) -> Column:
    return F.length(_digits(value)).between(low, high)


def base_spans(text: Column, digits: Column) -> dict[str, Column]:
    """What the four rules accept."""
    return {
        "email": F.when(text.contains("@"), matches(text, EMAIL)).otherwise(F.filter(digits, lambda x: F.lit(False))),
        "ip": F.filter(matches(text, IP), lambda x: x.value.rlike(VALID_IP)),
        "card": F.filter(digits, lambda x: _count_between(x.value, 16, 19) & luhn(x.value)),
        "phone": F.filter(matches(text, PHONE), lambda x: _count_between(x.value, 8, 15)),
    }


def _side(char: Column) -> Column:
    """Class of the character beside a span."""
    return (
        F.when(char.rlike(r"^\s?$"), 0).when(char.rlike("^[0-9]"), 1).when(char.rlike(r"^\p{L}"), 2)
        .when(char.rlike("^[\"']"), 3).when(char.rlike("^[=:]"), 4).otherwise(5)
    )


def _step(n: Column, *bounds: int) -> Column:
    """How many of the bounds ``n`` reaches."""
    total = F.lit(0)
    for b in bounds:
        total = total + (n >= b).cast("int")
    return total


def _candidate(text: Column, x: Column, kind: int, word: Column, label: Column) -> Column:
    before = lambda n: F.substring(text, F.greatest(x.start - n + 1, F.lit(1)), F.least(x.start, F.lit(n)))
    value = x.value
    letters = F.when(value.rlike("^[^A-Za-z]*$"), 0).when(value.rlike("^[^g-zG-Z]*$"), 1).otherwise(2)
    return F.struct(
        x.start.alias("start"), x.end.alias("end"), F.lit(kind).alias("kind"),
        _step(F.length(_digits(value)), 4, 7, 9, 10, 11, 13, 15, 16, 17, 20).alias("digits"),
        _step(F.size(F.split(value, r"[\x20().-]+")), 2, 3, 4, 5, 6).alias("groups"),
        _step(F.length(value), 8, 12, 16, 20, 24, 32, 40, 41).alias("length"),
        letters.alias("letters"),
        _side(before(1)).alias("left"),
        _side(F.substring(text, x.end + 1, F.lit(1))).alias("right"),
        word(before(24)).cast("int").alias("word"),
        label(before(24)).cast("int").alias("label"),
    )


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s.start < end) & (s.end > start))


def propose(documents: DataFrame, text: str, spans: str, candidates: str) -> DataFrame:
    """Add the rules' spans (a struct of arrays) and the further candidates of each text."""
    whole = or_empty(text)
    digits = fresh(documents, "_digits")
    found = documents.withColumn(digits, matches(whole, DIGITS))
    base = base_spans(whole, F.col(digits))
    bare = lambda a: F.transform(a, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
    found = found.withColumn(spans, F.struct(*[bare(base[k]).alias(k) for k in BASE_KINDS]))
    phones = F.col(spans).phone
    cards = F.filter(F.col(digits), lambda x: _count_between(x.value, 13, 19))
    keys = F.filter(matches(whole, KEY), lambda x: x.value.rlike("[0-9]") & x.value.rlike("[A-Za-z]"))
    groups = [
        F.transform(cards, lambda x: _candidate(whole, x, 0, lambda b: b.rlike(CARD_WORD), lambda b: luhn(x.value))),
        F.transform(
            matches(whole, LOCAL_PHONE),
            lambda x: _candidate(whole, x, 1, lambda b: b.rlike(PHONE_WORD), lambda b: _overlaps(phones, x.start, x.end)),
        ),
        F.transform(keys, lambda x: _candidate(whole, x, 2, lambda b: F.lit(False), lambda b: b.rlike(KEY_WORD))),
    ]
    return found.withColumn(candidates, F.concat(*groups)).drop(digits)


def fit(proposed: DataFrame, candidates: str, fold: Column, precision: float = PRECISION) -> tuple[boosting.Trees, list[float]]:
    """Trees and the threshold of each added kind; only cell counts reach the driver."""
    cells = (
        proposed.select(F.explode(candidates).alias("c"), fold.cast("int").alias("fold"))
        .groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c.label").alias("positive"))
        .collect()
    )
    table = np.array([[r["fold"], *[r[f] for f in FEATURES], r["n"], r["positive"]] for r in cells], np.int64)
    table = table.reshape(-1, len(FEATURES) + 3)
    # Sums of gradients depend on the order of the cells in their last digits.
    table = table[np.lexsort(table.T[::-1])]
    fitted = lambda rows: boosting.fit(FEATURES, rows[:, 1:-2], rows[:, -2], rows[:, -1])
    margin = np.zeros(len(table))
    for part in range(FOLDS):
        own = table[:, 0] == part
        if own.any():
            margin[own] = fitted(table[~own]).margin(table[own, 1:-2])
    least = []
    for kind in range(len(ADDED_KINDS)):
        own = table[:, 1] == kind
        least.append(boosting.least_margin(margin[own], table[own, -2], table[own, -1], precision))
    return fitted(table), least


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end")))


def _of_kind(spans: Column, code: int) -> Column:
    return F.filter(spans, lambda x: x.kind == code)


def _chosen(proposed: DataFrame, base: str, candidates: str, out: str, model: boosting.Trees, least: list[float]) -> DataFrame:
    """Add ``out``: the spans of ``base`` and the selected candidates."""
    base_all = F.concat(*[F.col(f"{base}.{k}") for k in BASE_KINDS])
    # Margins are worked out inside the array; a candidate over a base span or an earlier better one gives way.
    scored = F.transform(
        candidates,
        lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), model.column(lambda f: x[f]).alias("margin")),
    )

    def passes(x: Column) -> Column:
        ok = F.lit(False)
        for kind, bound in enumerate(least):
            if bound < math.inf:
                ok = ok | ((x.kind == kind) & (x.margin >= bound))
        return ok & ~_overlaps(base_all, x.start, x.end)

    chosen = F.array_sort(F.filter(scored, passes), lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(b.end - a.end))
    apart = F.aggregate(
        chosen,
        F.array().cast("array<struct<kind: int, start: int, end: int, margin: double>>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (F.element_at(kept, -1).end <= x.start), F.concat(kept, F.array(x))).otherwise(kept),
    )
    added = fresh(proposed, "_added")
    by_kind = []
    for kind in dict.fromkeys((*BASE_KINDS, *ADDED_KINDS)):
        parts = [_named(kind, F.col(f"{base}.{kind}"))] if kind in BASE_KINDS else []
        if kind in ADDED_KINDS:
            code = ADDED_KINDS.index(kind)
            parts.append(_named(kind, _of_kind(F.col(added), code)))
        by_kind.append(F.array_sort(F.concat(*parts)))
    return proposed.withColumn(added, apart).withColumn(out, F.concat(*by_kind)).drop(added)


def _fold(text: str) -> Column:
    """The part that a text belongs to."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS))


def redact(documents: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """Replace every span of ``text`` by its kind in angle brackets; overlapping spans become one, of the first's kind.

    A null text stays null.  All columns are kept.  Nothing is shuffled; the
    generators run once for fitting and once for replacing.
    """
    base, candidates, found = (fresh(documents, name) for name in ("_base", "_candidates", "_spans"))
    proposed = propose(documents, text, base, candidates)
    model, least = fit(proposed, candidates, _fold(text), precision)
    spans = F.array_sort(F.transform(found, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    whole = F.col(text)
    step = lambda acc, s: F.struct(
        F.greatest(acc.at, s.end).alias("at"),
        F.when(s.start < acc.at, acc.out)
        .otherwise(F.concat(acc.out, F.substring(whole, acc.at + 1, s.start - acc.at), F.lit("<"), s.kind, F.lit(">")))
        .alias("out"),
    )
    done = lambda acc: F.concat(acc.out, F.substring(whole, acc.at + 1, F.length(whole) - acc.at))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.when(F.size(found) > 0, F.aggregate(spans, start, step, done)).otherwise(whole)
    return _chosen(proposed, base, candidates, found, model, least).withColumn(text, clean).select(documents.columns)


def find_personal_data(documents: DataFrame, text: str = "text", precision: float = PRECISION) -> DataFrame:
    """Add ``base`` (struct of arrays by kind) and ``spans`` (array of kind, start, end: base ones and added ones).

    Null and empty texts have no spans.  Repeated rows get equal spans.  Columns
    of those names are replaced, others are kept; the rows are written once to
    the shared folder without ``text``.  In an empty table nothing is learned.
    """
    fold, candidates = fresh(documents, "_fold"), fresh(documents, "_candidates")
    plain = documents.withColumn(fold, _fold(text))
    proposed = stage(propose(plain, text, "base", candidates).drop(text), "candidates")
    model, least = fit(proposed, candidates, F.col(fold), precision)
    return _chosen(proposed, "base", candidates, "spans", model, least).drop(candidates, fold)


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digests() -> list[Column]:
    named = [_named(k, F.col(f"base.{k}")) for k in BASE_KINDS]
    return [
        *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_join(F.concat(*named)), 256).alias("base_sha256"),
        _join(F.col("spans")).alias("spans"),
    ]
