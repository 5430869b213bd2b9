"""Vector lookups by text id, with the query overlay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from pairforge.operators.membership import Membership
from pairforge.operators.ordering import dense_position
from pairforge.operators.skew import Salting, hot_keys_of, skew_join


def overlay(embeddings: DataFrame) -> DataFrame:
    """Per text the document vector and the query vector, which defaults to the document one."""
    doc = embeddings.filter(F.col("kind") == "doc").select("text_id", F.col("vec").alias("doc_vec"))
    query = embeddings.filter(F.col("kind") == "query").select("text_id", F.col("vec").alias("_q"))
    return doc.join(query, "text_id", "left").select(
        "text_id", "doc_vec", F.coalesce("_q", "doc_vec").alias("query_vec")
    )


def lookup_vectors(
    refs: DataFrame,
    embeddings: DataFrame,
    spread: Sequence[str],
    *,
    use_query: str | None = None,
    out: str = "vec",
    hot: Mapping | None = None,
) -> DataFrame:
    """Attach to each ref the vector of its ``text_id``; refs without one are dropped.

    ``use_query`` names a boolean column that asks for the query vector where there is one.
    """
    return attach_vectors(refs, {out: (embeddings, use_query)}, spread, hot)


def attach_vectors(
    refs: DataFrame,
    tables: dict[str, tuple[DataFrame, str | None]],
    spread: Sequence[str],
    hot: Mapping | None = None,
) -> DataFrame:
    """Attach vectors of several embedding tables at once.

    ``tables`` maps the output column to (embeddings, flag column or None).  All
    joins share one key and one salting, so refs are shuffled a single time.
    """
    plan = Salting("text_id", hot_keys_of(refs, "text_id") if hot is None else dict(hot))
    joined, outputs = plan.left(refs, spread), []

    def of_kind(embeddings: DataFrame, kind: str, name: str) -> DataFrame:
        rows = embeddings.filter(F.col("kind") == kind)
        return plan.right(rows.select("text_id", F.col("vec").alias(name)))

    for name, (embeddings, flag) in tables.items():
        joined = joined.join(of_kind(embeddings, "doc", f"_d_{name}"), plan.on)
        vector = F.col(f"_d_{name}")
        if flag:
            joined = joined.join(of_kind(embeddings, "query", f"_q_{name}"), plan.on, "left")
            vector = F.when(F.col(flag), F.coalesce(f"_q_{name}", f"_d_{name}")).otherwise(vector)
        outputs.append(vector.alias(name))
    return joined.select(*refs.columns, *outputs)


def known_ids(embeddings: DataFrame, **options) -> Membership | None:
    """A filter of the text ids that have a document vector, for lookups in which many refs have none."""
    return Membership.of(_known(embeddings), "text_id", **options)


def with_vector(
    refs: DataFrame, embeddings: DataFrame, spread: Sequence[str], hot: Mapping | None = None, members: Membership | None = None
) -> DataFrame:
    """Refs whose text id has a document vector.  Refs that ``members`` denies are dropped before the shuffle."""
    asked = refs if members is None else refs.filter(members.may_hold("text_id"))
    return skew_join(asked, _known(embeddings), "text_id", "left_semi", spread, hot)


def without_vector(
    refs: DataFrame, embeddings: DataFrame, spread: Sequence[str], hot: Mapping | None = None, members: Membership | None = None
) -> DataFrame:
    """Refs whose text id has no document vector.  Refs that ``members`` denies are taken without a shuffle."""
    if members is None:
        return skew_join(refs, _known(embeddings), "text_id", "left_anti", spread, hot)
    may = members.may_hold("text_id")
    lacking = skew_join(refs.filter(may), _known(embeddings), "text_id", "left_anti", spread, hot)
    return refs.filter(~may).unionByName(lacking)


def _known(embeddings: DataFrame) -> DataFrame:
    return embeddings.filter(F.col("kind") == "doc").select("text_id")


def row_numbers(texts: DataFrame, out: str = "row") -> DataFrame:
    """Dense row number of each text id, by language and then id (for row-addressed exports).

    The id ends in 16 hash digits; three of them fill 4,096 even buckets per language.
    """
    lang = F.substring("text_id", F.lit(1), F.length("text_id") - 17)
    digits = F.substring("text_id", F.length("text_id") - 15, F.lit(3))
    return dense_position(texts, [lang, digits], [lang, "text_id"], out=out)
