"""Deterministic batches and the pairs inside them.

Everything up to the text cap is computed per example (start offset and number
of kept sides), so texts are never shuffled to be counted, and all pairs come
from arrays of the example's own row, so no self-join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairforge import constants as K
from pairforge.functions.prompts import (
    Prompts,
    effective_student_prompt,
    wants_query_vector,
)
from pairforge.operators.keys import meet_by_order
from pairforge.operators.lookup import without_vector
from pairforge.operators.membership import Membership
from pairforge.operators.ordering import dense_position, hash_bucket
from pairforge.schemas import ORDER_KEY


def assign_batches(
    examples: DataFrame,
    *,
    seed: int = 0,
    epoch: int = 0,
    world: int = 1,
    batch_size: int = K.DEFAULT_BATCH_SIZE,
) -> DataFrame:
    """Shuffle by hash, deal round-robin to ``world`` ranks, cut into full batches.

    Adds ``step``, ``rank`` and ``slot`` (position in the batch).  The order hash
    depends on seed, epoch and example key only.  All ranks get equally many full
    batches; the rows beyond are dropped.
    """
    mixed = F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *ORDER_KEY)
    hashed = examples.withColumn("_h", F.sha1(mixed))
    placed = dense_position(hashed, hash_bucket("_h"), ["_h", *ORDER_KEY], out="_pos", total="_n")
    world_col = F.lit(world)
    rank = F.pmod("_pos", world_col)
    turn = F.floor(F.col("_pos") / world_col)
    # Every rank gets the number of full batches that the rank with the fewest rows can fill.
    full = F.floor(F.floor(F.col("_n") / world_col) / F.lit(batch_size))
    return (
        placed.select(
            *examples.columns,
            F.floor(turn / F.lit(batch_size)).alias("step"),
            rank.cast("int").alias("rank"),
            F.pmod(turn, F.lit(batch_size)).cast("int").alias("slot"),
            full.alias("_full"),
        )
        .filter(F.col("step") < F.col("_full"))
        .drop("_full")
    )


def eligible(
    examples: DataFrame, embeddings: DataFrame, hot: Mapping | None = None, members: Membership | None = None
) -> DataFrame:
    """Examples with ids on every side and a document vector for every id.

    With ``members`` ids that surely lack one are not shuffled to find that out.
    """
    named = examples.filter(
        F.col("text_ids").isNotNull() & F.forall("text_ids", lambda t: t.isNotNull())
    )
    sides = named.select(*ORDER_KEY, F.explode("text_ids").alias("text_id"))
    lacking = without_vector(sides, embeddings, ORDER_KEY, hot, members).select(*ORDER_KEY).distinct()
    return named.join(lacking, list(ORDER_KEY), "left_anti")


def cap_batch_texts(batches: DataFrame, max_texts: int = K.DEFAULT_TEXTS_PER_BATCH) -> DataFrame:
    """Add ``start`` (index of the example's first text in the batch) and ``kept`` (sides kept).

    A batch holds at most ``batch_size`` examples, so the window group is bounded.
    Examples that fall behind the cap entirely are dropped.
    """
    size = F.size("text_ids")
    ahead = W.partitionBy("step", "rank").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return (
        batches.withColumn("start", F.coalesce(F.sum(size).over(ahead), F.lit(0)).cast("int"))
        .withColumn("kept", F.least(size, F.lit(max_texts) - F.col("start")))
        .filter(F.col("kept") > 0)
    )


def with_texts(rows: DataFrame, examples: DataFrame) -> DataFrame:
    """``rows`` of ``examples`` that were dealt without ``texts`` with them again; rows of one key and ids keep their number."""
    met = meet_by_order(examples.select(*ORDER_KEY, "text_ids", "texts"), rows, ["text_ids"])
    own = met.select(*ORDER_KEY, "text_ids", "texts", F.get("_found", F.col("_copy")).alias("_r")).filter(F.col("_r").isNotNull())
    kept = [c for c in rows.columns if c not in (*ORDER_KEY, "text_ids")]
    flat = own.select(*ORDER_KEY, "text_ids", "texts", *[F.col(f"_r.{c}").alias(c) for c in kept])
    return flat.select(*examples.columns, *[c for c in kept if c not in examples.columns])


def student_ids(examples: DataFrame, prompts: Prompts | None = None) -> DataFrame:
    """``examples`` with ``student_ids``, the hash of each side's prompted text, which stands for it where texts stay behind."""
    prompts = prompts or Prompts()

    def key(z: Column) -> Column:
        return F.sha1(prompts.student_text(effective_student_prompt(z["roles"], z["student_prompt_names"]), z["texts"]))

    return examples.withColumn("student_ids", F.transform(F.arrays_zip("texts", "roles", "student_prompt_names"), key))


def student_texts(sides: DataFrame, examples: DataFrame, prompts: Prompts | None = None) -> DataFrame:
    """Distinct ``(text_id, text, kind)`` of the student texts of ``sides`` by ``student_id``, fetched from ``examples``.

    ``examples`` have ``student_ids``.  One side is chosen for each id, and its text alone is taken.
    """
    prompts = prompts or Prompts()
    place = F.struct(*ORDER_KEY, "side", "student_ids")
    wanted = sides.groupBy("student_id").agg(F.min(place).alias("_p")).select(
        *[F.col(f"_p.{c}").alias(c) for c in (*ORDER_KEY, "side", "student_ids")], "student_id"
    )
    lists = ("texts", "roles", "student_prompt_names")
    met = meet_by_order(examples.select(*ORDER_KEY, "student_ids", *lists), wanted, ["student_ids"]).filter("_copy = 0")
    text, role, name = (F.get(c, F.col("_f.side")) for c in lists)
    return met.select(*lists, F.explode("_found").alias("_f")).select(
        F.col("_f.student_id").alias("text_id"),
        prompts.student_text(effective_student_prompt(role, name), text).alias("text"),
        F.lit("doc").alias("kind"),
    )


def batch_texts(capped: DataFrame, prompts: Prompts | None = None) -> DataFrame:
    """One row per text of a batch, in the order of ``local_idx``, ready for encoding and lookup.

    Batches without ``texts`` give no ``student_text``; with ``student_ids`` there is the ``student_id`` of each side, and the whole list.
    """
    prompts = prompts or Prompts()
    lists = [c for c in ("text_ids", "texts", "roles", "student_prompt_names", "student_ids") if c in capped.columns]
    sides = F.arrays_zip(*[F.slice(c, F.lit(1), F.col("kept")).alias(c) for c in lists])
    whole = ["student_ids"] if "student_ids" in lists else []
    rows = capped.select(
        "step", "rank", "slot", *ORDER_KEY, "task", "label", "start", *whole, F.posexplode(sides).alias("side", "_z")
    )
    role, side = F.col("_z.roles"), F.col("side")
    prompt = effective_student_prompt(role, F.col("_z.student_prompt_names"))
    text = [prompts.student_text(prompt, F.col("_z.texts")).alias("student_text")] if "texts" in lists else []
    return rows.select(
        "step",
        "rank",
        (F.col("start") + side).alias("local_idx"),
        *ORDER_KEY,
        "side",
        role.alias("role"),
        "task",
        "label",
        F.col("_z.text_ids").alias("text_id"),
        *text,
        wants_query_vector(F.col("task"), role, side).alias("use_query"),
        *([F.col("_z.student_ids").alias("student_id"), "student_ids"] if whole else []),
    )


def _indices(role: str) -> Column:
    """Batch indices of the example's kept sides with this role."""
    marked = F.transform(
        F.slice("roles", F.lit(1), F.col("kept")),
        lambda r, i: F.when(r == role, F.col("start") + i),
    )
    return F.array_compact(marked)


def _pairs(left: Column, right: Column) -> Column:
    return F.flatten(
        F.transform(left, lambda i: F.transform(right, lambda j: F.struct(i.alias("i"), j.alias("j"))))
    )


def _either(condition: Column, pairs: Column) -> Column:
    return F.when(condition, pairs).otherwise(F.array().cast("array<struct<i:int,j:int>>"))


def _with_roles(capped: DataFrame) -> DataFrame:
    """Index lists by role; an example cut below two texts yields no pairs."""
    usable = capped.filter(F.col("kept") >= 2)
    return usable.select(
        "step",
        "rank",
        "task",
        "label",
        "start",
        _indices("query").alias("_query"),
        _indices("positive").alias("_positive"),
        _indices("sentence_a").alias("_a"),
        _indices("sentence_b").alias("_b"),
        F.array("start").alias("_first"),
        F.array(F.col("start") + 1).alias("_second"),
    )


def positive_pairs(capped: DataFrame, min_label: float = K.POSITIVE_LABEL_MIN) -> DataFrame:
    """The set of positive pairs ``(step, rank, i, j)``, both directions.

    Query with positive; sentence a with b and unlabelled-role pairs when the
    label is null or high enough; the first two texts of a bitext example.
    """
    similar = F.col("label").isNull() | (F.col("label") >= min_label)
    no_a = F.size("_a") == 0
    first_two = _pairs(F.col("_first"), F.col("_second"))
    one_way = F.concat(
        _pairs(F.col("_query"), F.col("_positive")),
        _either(similar, _pairs(F.col("_a"), F.col("_b"))),
        _either(F.col("task") == "bitext", first_two),
        _either((F.col("task") == "sts") & no_a & similar, first_two),
    )
    both = F.concat(
        F.col("_one"),
        F.transform("_one", lambda p: F.struct(p["j"].alias("i"), p["i"].alias("j"))),
    )
    # Indices belong to one example, so the set is distinct per example row.
    return (
        _with_roles(capped)
        .select("step", "rank", one_way.alias("_one"))
        .select("step", "rank", F.explode(F.array_distinct(both)).alias("_p"))
        .select("step", "rank", "_p.i", "_p.j")
    )


def graded_pairs(capped: DataFrame) -> DataFrame:
    """The list of graded pairs ``(step, rank, i, j)``, with any label; repeats stay."""
    first_two = _pairs(F.col("_first"), F.col("_second"))
    no_a, no_b = F.size("_a") == 0, F.size("_b") == 0
    pairs = F.concat(
        _pairs(F.col("_a"), F.col("_b")),
        _either((F.col("task") == "bitext") & (no_a | no_b), first_two),
        _either((F.col("task") == "sts") & no_a, first_two),
    )
    return (
        _with_roles(capped)
        .select("step", "rank", F.explode(pairs).alias("_p"))
        .select("step", "rank", "_p.i", "_p.j")
    )


def within_batch(rows: DataFrame, max_texts: int, *indices: str) -> DataFrame:
    """Rows whose batch indices lie in ``[0, max_texts)``: truncation and the pad mask in one."""
    for name in indices:
        rows = rows.filter((F.col(name) >= 0) & (F.col(name) < max_texts))
    return rows


def to_global(rows: DataFrame, max_texts: int, **indices: str) -> DataFrame:
    """Global index ``rank * max_texts + local`` under new names, e.g. ``gi="i"``.

    Pairs keep their own rank's block, so they never cross ranks.
    """
    for new, local in indices.items():
        rows = rows.withColumn(new, F.col("rank").cast("long") * max_texts + F.col(local))
    return rows
