"""Content keys, distinct texts (late materialised) and the cap on unique texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from pairforge.functions.text import base_lang, text_id
from pairforge.operators.ordering import cutoff_key, packed_order, unpacked_order
from pairforge.operators.skew import hot_keys, skew_join
from pairforge.schemas import ORDER_KEY

TEXT_ORDER = (*ORDER_KEY, "side")

# Bits of the row numbers of a block of neighbouring examples.
NEIGHBOURS = 6


def assign_text_ids(examples: DataFrame, per_side_lang: bool = False) -> DataFrame:
    """Fill ``text_ids``, aligned to ``texts``.  A projection, no shuffle.

    All sides carry the language before the first dash.  ``per_side_lang``
    instead gives side *k* the *k*-th dash part where there is one.
    """
    if not per_side_lang:
        ids = F.transform("texts", lambda t: text_id(t, base_lang(F.col("lang"))))
    else:
        parts = F.split("lang", "-")
        ids = F.transform(
            "texts", lambda t, i: text_id(t, F.coalesce(F.get(parts, i), base_lang(F.col("lang"))))
        )
    return examples.withColumn("text_ids", ids)


def explode_sides(examples: DataFrame, *columns: str) -> DataFrame:
    """One row per side with ``side`` and the named element columns.

    ``columns`` picks from text, role, t_prompt, s_prompt, text_id; only what is
    asked for is carried.
    """
    source = {
        "text": "texts",
        "role": "roles",
        "t_prompt": "teacher_prompt_names",
        "s_prompt": "student_prompt_names",
        "text_id": "text_ids",
    }
    zipped = F.arrays_zip(*[F.col(source[c]) for c in columns])
    keep = [c for c in examples.columns if c not in source.values()]
    return examples.select(*keep, F.posexplode(zipped).alias("side", "_z")).select(
        *keep, "side", *[F.col(f"_z.{source[c]}").alias(c) for c in columns]
    )


def text_uses(examples: DataFrame) -> DataFrame:
    """One row per text id without its text: first appearance, last use and number of uses.

    Uses are order values of fixed width, so they combine in a hash aggregate on
    the map side and no text is sorted or shuffled; a text that fills a third of
    the corpus reaches the shuffle as one narrow row per task.
    """
    sides = explode_sides(examples.select(*ORDER_KEY, "text_ids"), "text_id")
    place = packed_order()
    uses = sides.select("text_id", place.alias("_place")).groupBy("text_id").agg(
        F.min("_place").alias("_first"), F.max("_place").alias("last_use"), F.count(F.lit(1)).alias("n_uses")
    )
    return uses.select("text_id", *unpacked_order("_first"), "last_use", "n_uses")


def meet_by_order(wide: DataFrame, narrow: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """``wide`` with ``_found``, all rows of ``narrow`` (as structs) that have its order key and ``more``, and ``_copy``.

    Rows move in blocks of neighbours and stand in their order: neighbours share
    texts, which compress to one in the shuffle and in what is written next.
    ``_copy`` counts the rows of ``wide`` that share a key, from 0.
    """
    keys = [*ORDER_KEY, *more]
    packed = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    rows = packed(wide, "_wide").unionByName(packed(narrow, "_narrow"), allowMissingColumns=True)
    blocks = rows.withColumn("_block", F.shiftright("row_ord", NEIGHBOURS)).repartition("source_seq", "_block")
    # Of one key the rows of ``wide`` come first; the whole key is seen from each of them.
    inside = W.partitionBy("source_seq", "_block", *keys[1:]).orderBy(F.col("_narrow").isNotNull())
    met = blocks.withColumns(
        {
            "_found": F.collect_list("_narrow").over(inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
            "_copy": F.row_number().over(inside) - 1,
        }
    ).filter(F.col("_wide").isNotNull())
    return met.select(*keys, *[F.col(f"_wide.{c}").alias(c) for c in wide.columns if c not in keys], "_found", "_copy")


def fetch_texts(uses: DataFrame, examples: DataFrame) -> DataFrame:
    """Add text and language of each id's last use; further columns of ``uses`` stay.

    Where two texts share an id the last one written wins, as it does for a keyed
    store.  Each text is fetched from the example that holds it, by the order
    key, which is unique: rows meet one to one, whatever ids are hot.
    """
    seq, row, side = unpacked_order("last_use")
    use = [c for c in uses.columns if c != "last_use"]
    wanted = uses.select(seq, row, side.alias("_side"), F.struct(*use).alias("use"))
    met = meet_by_order(examples.select(*ORDER_KEY, "lang", "texts"), wanted)
    found = met.select("texts", "lang", F.explode("_found").alias("_f"))
    more = [c for c in use if c not in ("text_id", *TEXT_ORDER, "n_uses")]
    return found.select(
        "_f.use.text_id",
        F.get("texts", F.col("_f._side")).alias("text"),
        base_lang(F.col("lang")).alias("lang"),
        *[F.col(f"_f.use.{c}").alias(c) for c in (*TEXT_ORDER, "n_uses", *more)],
    )


def distinct_texts(examples: DataFrame) -> DataFrame:
    """One row per text id with its text, language, first appearance and number of uses.

    Ids are combined without texts, then one text per id is fetched.
    """
    return fetch_texts(text_uses(examples), examples)


def cap_texts(texts: DataFrame, max_unique: int) -> DataFrame:
    """The first ``max_unique`` texts in order of first appearance; ``texts`` may be ``text_uses``."""
    cutoff = cutoff_key(texts, max_unique, TEXT_ORDER)
    return texts.filter(cutoff.isNull() | (F.struct(*TEXT_ORDER) <= cutoff))


def hot_texts(texts: DataFrame) -> dict:
    """Text ids that occur so often that lookups by them need salting."""
    return hot_keys(texts, "text_id", "n_uses")


def cap_examples(examples: DataFrame, texts: DataFrame, max_unique: int) -> DataFrame:
    """Examples whose every text is among the kept ones.

    A text first appears no later than any example that uses it, so examples up
    to the cutoff are complete by construction.  Only later ones are looked up.
    """
    cutoff = cutoff_key(texts, max_unique, TEXT_ORDER)
    last_side = F.struct(*ORDER_KEY, (F.size("text_ids") - 1).alias("side"))
    is_late = F.coalesce(last_side > cutoff, F.lit(False))
    late = examples.filter(is_late)
    sides = late.select(*ORDER_KEY, F.explode("text_ids").alias("text_id"))
    kept = cap_texts(texts.select("text_id", *TEXT_ORDER), max_unique).select("text_id")
    lacking = skew_join(sides, kept, "text_id", "left_anti", ORDER_KEY, hot_texts(texts))
    complete = late.join(lacking.select(*ORDER_KEY).distinct(), list(ORDER_KEY), "left_anti")
    return examples.filter(~is_late).unionByName(complete.select(*examples.columns))
