"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in DataFrame functions only.

* A leaf is a clause: a piece of a line that ends behind a mark of punctuation
  before a space; its node is the hash of its text.
* A paragraph is a line; its node is the hash of its leaves' nodes.
* A section is a group of paragraphs and ends behind one whose node is divisible
  by ``SECTION``, so an edit moves no border but its own.  Its node is the hash of
  its paragraphs' nodes.
* The root is the hash of the sections' nodes and the text's length.

A fingerprint is the tree as text: ``root/section;section``, a section being
``node:paragraph,paragraph`` and a paragraph ``node:leaf.leaf`` (nodes in
hexadecimal, shortened where they are only compared between two documents).
Equal texts have equal trees.  Two trees are compared from the top: equal roots end
it, equal sections and then equal paragraphs are passed over, and only leaves of
paragraphs that differ are looked at.  ``changed`` names these paragraphs,
``likeness`` is the weight of the leaves that are shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pairforge.llm.inputs import bound, ids_and_texts, or_empty

SECTION = 4
#: Documents of one task when neighbours are looked up, in expectation.
BUCKET_ROWS = 512
#: Buckets of one task when the buckets themselves are put in order.
GROUP = 1 << 16

#: Hexadecimal digits that are kept of a leaf's node, and of other nodes below the root.
LEAF_DIGITS, NODE_DIGITS = 12, 16

_CLAUSE = r"(?<=[^\p{L}\p{N}]) "


def _hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(value)), 16, "0"))


def _node(below: Column) -> Column:
    return F.substring(F.sha2(below, 256), 1, NODE_DIGITS)


def _paragraph(leaves: Column) -> Column:
    """``node:leaf.leaf`` from the whole nodes of the leaves; the paragraph's node is that of the whole ones."""
    kept = F.regexp_replace(leaves, f"([0-9a-f]{{{LEAF_DIGITS}}})[0-9a-f]{{{16 - LEAF_DIGITS}}}", "$1.")
    return F.concat(_node(leaves), F.lit(":"), F.rtrim(kept, F.lit(".")))


def _section(paragraphs: Column) -> Column:
    """``node:paragraph,paragraph``; the node is that of the paragraphs' nodes."""
    return F.concat(_node(F.regexp_replace(paragraphs, ":[0-9a-f.]*,?", "")), F.lit(":"), F.rtrim(paragraphs, F.lit(",")))


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string; null counts as empty text."""
    lines = F.split(or_empty(text), "\n")
    paragraphs = F.transform(F.transform(lines, lambda line: F.array_join(F.transform(F.split(line, _CLAUSE), _hex64), "")), _paragraph)
    # A border follows each paragraph whose node is a multiple of SECTION; the others are joined by a comma.
    marked = F.transform(paragraphs, lambda p: F.concat(p, F.when(F.substring(p, NODE_DIGITS, 1).isin(*_BORDERS), ";").otherwise(",")))
    sections = F.transform(F.filter(F.split(F.array_join(marked, ""), ";"), lambda s: s != ""), _section)
    size = F.length(or_empty(text)).cast("string")

    def tree(parts: Column) -> Column:
        nodes = F.array_join(F.transform(parts, lambda s: F.substring(s, 1, NODE_DIGITS)), "")
        return F.concat(F.substring(F.sha2(F.concat(size, F.lit(":"), nodes), 256), 1, 32), F.lit("/"), F.array_join(parts, ";"))

    return bound(sections, tree)


#: Last digits of nodes that are multiples of SECTION.
_BORDERS = [f"{d:x}" for d in range(0, 16, SECTION)]


def root(print_: Column) -> Column:
    return F.substring_index(print_, "/", 1)


def _sections(print_: Column) -> Column:
    return F.split(F.substring_index(print_, "/", -1), ";")


def _below(nodes: Column, mark: str) -> Column:
    """What lies below nodes, one after the other."""
    return F.flatten(F.transform(nodes, lambda n: F.split(F.substring(n, F.lit(NODE_DIGITS + 2), F.length(n)), mark)))


def _n_leaves(print_: Column) -> Column:
    """Leaves of a tree: dots and the ends of paragraphs."""
    tree = F.substring_index(print_, "/", -1)
    return F.length(tree) - F.length(F.translate(tree, ".,;", "")) + 1


def _apart(x: Column, y: Column, then) -> Column:
    """``then`` of what only ``x`` has and what only ``y`` has."""
    both = F.struct(F.array_except(x, y).alias("a"), F.array_except(y, x).alias("b"))
    return bound(both, lambda only: then(only.a, only.b))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of leaves of both trees that do not differ.

    Leaves below an equal section, or an equal paragraph of sections that differ,
    are shared; of the others those that stand below a differing paragraph of the
    other tree, too.  A branch that repeats inside a tree counts once where it differs.
    """

    def below(mark: str, then):
        return lambda x, y: _apart(_below(x, mark), _below(y, mark), then)

    n_apart = _apart(_sections(a), _sections(b), below(",", below("[.]", lambda x, y: F.size(x) + F.size(y))))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(1.0 - n_apart / (_n_leaves(a) + _n_leaves(b)))


def changed(a: Column, b: Column) -> Column:
    """Paragraph numbers (from 0) of ``a`` whose node ``b`` does not have; none for equal roots.

    Sections that both trees have are passed over without a look at their paragraphs.
    """
    known, paragraphs = _sections(b), _below(_sections(b), ",")
    flagged = F.flatten(
        F.transform(
            _sections(a),
            lambda s: F.transform(_below(F.array(s), ","), lambda p: ~F.array_contains(known, s) & ~F.array_contains(paragraphs, p)),
        )
    )
    at = F.filter(F.transform(flagged, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(at)


def edit(text: Column, other: Column) -> Column:
    """The last half (rounded down) of the code points gives way to the first as many (or all) of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def _bucket_width(docs: DataFrame) -> int:
    """Ids of one bucket, so that it holds about ``BUCKET_ROWS`` documents where ids lie closest. Reads only the ids.

    Percentiles tell how close they lie; far ids or thin regions make buckets of
    fewer documents, never larger ones.
    """
    shares = F.array(*[F.lit(i / 100) for i in range(101)])
    at, n = docs.agg(F.percentile_approx("doc_id", shares, F.lit(10_000)), F.count("doc_id")).first()
    gaps = [high - low for low, high in zip(at or [], (at or [])[1:]) if high > low]
    return min(max(1, min(gaps) * 100 * BUCKET_ROWS // n), 1 << 62) if gaps else 1


def _next_bucket(docs: DataFrame) -> DataFrame:
    """bucket, following (the next one that has rows; after the last the first one).

    Buckets are ordered in groups, and only the groups' first buckets globally:
    one row for 33 million documents.
    """
    buckets = docs.select("bucket").distinct().withColumn("group", F.floor(F.col("bucket") / GROUP))
    firsts = buckets.groupBy("group").agg(F.min("bucket").alias("first"))
    turn = W.orderBy("group")
    after = firsts.select("group", F.coalesce(F.lead("first").over(turn), F.first("first").over(turn)).alias("after"))
    inside = F.lead("bucket").over(W.partitionBy("group").orderBy("bucket"))
    return buckets.withColumn("inside", inside).join(after, "group").select("bucket", F.coalesce("inside", "after").alias("following"))


def with_next(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null as empty), print, next_text and next_print of the next id.

    Ids are cut into buckets of near ids.  Inside a bucket the next row is the
    next document; the last row of a bucket gets the first one of the next
    bucket, a join of one row for each bucket.  Rows with equal ids follow each
    other in order of their texts; rows without an id are last.
    """
    docs = ids_and_texts(documents, doc_id, text).withColumn("text", or_empty("text"))
    width = _bucket_width(docs)
    # Without an id a row gets a bucket by its text, behind all others.
    lost = F.lit((1 << 62) // width) + F.pmod(F.xxhash64("text"), F.lit(1 << 10))
    bucket = F.coalesce(F.floor(F.col("doc_id") / width).cast("long"), lost)
    # The texts are shuffled once, without fingerprints; the three uses below share that shuffle.
    dealt = docs.withColumn("bucket", bucket).repartition("bucket")
    order = W.partitionBy("bucket").orderBy(F.asc_nulls_last("doc_id"), "text")
    inside = dealt.withColumn("print", fingerprint(F.col("text"))).select(
        "doc_id", "text", "print", F.lead("text").over(order).alias("next_text"), F.lead("print").over(order).alias("next_print")
    )
    placed = dealt.select("*", F.row_number().over(order).alias("place"), F.lead(F.lit(True)).over(order).alias("more"))
    first = placed.filter("place = 1").select(F.col("bucket").alias("following"), F.col("text").alias("next_text"))
    last = placed.filter("more IS NULL").select("doc_id", "text", "bucket")
    ends = last.join(_next_bucket(docs.select(bucket.alias("bucket"))), "bucket").join(first, "following")
    return inside.filter("next_text IS NOT NULL").unionByName(
        ends.select("doc_id", "text", "next_text", *[fingerprint(F.col(c)).alias(p) for c, p in (("text", "print"), ("next_text", "next_print"))])
    )


def compare_edited(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses; see ``with_next``.

    A single document is its own next one; an empty table gives an empty result.
    """
    rows = with_next(documents, doc_id, text).withColumn("edited", edit(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_print", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
