"""Source-shaped tables derived by Spark from the given tables.

Each function takes (spark, sf_dir) and grows with the tables.  The SQL
counterparts are in ``oracles.CTES`` under the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pairforge.operators import normalize
from pairforge.operators.encode import query_prompted_texts
from pairforge.operators.keys import assign_text_ids
from pairforge.operators.lookup import row_numbers
from pairforge.operators import ordering
from pairforge.operators.ordering import dense_position
from pairforge.session import stage
from pairforge.sources.catalogue import union_examples

MISSING_LABEL = 9
CONVERSATIONS = 1 << 14  # of one bucket when turns are numbered
TURNS = 16  # of a part of a conversation
NEIGHBOURS = 10  # bits of the ids of a block of neighbouring documents

# Declared, so that opening a table runs no schema-inference job.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its successor, graded by the labels that exist.

    Texts are shuffled once, in blocks of neighbours; the first document of a block goes to the block before as well.
    """
    block = lambda at: F.shiftright(at, NEIGHBOURS)
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_ord"), F.struct("lang", "text").alias("doc"), F.lit(None).cast("struct<score:double>").alias("grade")
    )
    blocks = F.array_distinct(F.array(block(F.col("row_ord")), block(F.col("row_ord") - 1)))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_ord"),
        F.struct((F.col("quality") * 5 - F.col("toxic") * 2).cast("double").alias("score")).alias("grade"),
        block(F.col("doc_id")).alias("_block"),
    )
    rows = docs.withColumn("_block", F.explode(blocks)).unionByName(labels, allowMissingColumns=True).filter(F.col("row_ord").isNotNull())
    inside = W.partitionBy("_block").orderBy("row_ord")
    met = rows.withColumns(
        {
            "_next": F.collect_list(F.col("doc")).over(inside.rangeBetween(1, 1)),
            "_grades": F.collect_list("grade").over(inside.rangeBetween(0, 0)),
        }
    )
    own = met.filter(F.col("doc").isNotNull() & (F.col("_block") == block(F.col("row_ord"))))
    graded = own.select("row_ord", "doc", "_next", F.explode_outer("_grades").alias("grade"))
    return graded.select("row_ord", "doc", "grade", F.explode("_next").alias("next")).select(
        "row_ord", "doc.lang", F.col("doc.text").alias("sentence1"), F.col("next.text").alias("sentence2"), "grade.score"
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows.

    Conversation and turn together are the key, so a very long conversation spreads.
    """
    conv = table(spark, sf_dir, "conversations")
    asked = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    replied = conv.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    pairs = asked.join(replied.hint("merge"), ["conv_id", "turn"])
    block = [F.floor(F.col("conv_id") / F.lit(CONVERSATIONS))]
    placed = dense_position(pairs, block, ["conv_id", "turn"], out="row_ord")
    return placed.select("conv_id", "row_ord", "query", "answer", F.floor(F.col("turn") / F.lit(TURNS)).alias("part"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a list of negatives: the replies of the next conversation in the same part of ``TURNS`` turns.

    A part bounds the list and its copies, however long a conversation is.
    """
    conv = table(spark, sf_dir, "conversations")
    replies = (
        conv.filter(F.col("role") == "assistant")
        .groupBy((F.col("conv_id") - 1).alias("conv_id"), F.floor(F.col("turn") / F.lit(TURNS)).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_r"))
        .select("conv_id", "part", F.transform("_r", lambda r: r["text"]).alias("_replies"))
    )
    none = F.array().cast("array<string>")
    blank = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(""))).otherwise(none)
    negatives = F.concat(blank, F.coalesce("_replies", none))
    return (
        turns(spark, sf_dir)
        .join(replies, ["conv_id", "part"], "left")
        .select("conv_id", "row_ord", "query", F.col("answer").alias("positive"), negatives.alias("negative"))
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with passage structs whose text sits in either field."""
    swapped = F.col("conv_id") % 4 == 0

    def passage(text):
        return F.struct(
            F.when(swapped, F.lit("")).otherwise(text).alias("text"),
            F.when(swapped, text).alias("passage"),
        )

    return triples(spark, sf_dir).select(
        "row_ord",
        "query",
        F.array(passage(F.col("positive"))).alias("positive_passages"),
        F.transform("negative", passage).alias("negative_passages"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as question and answer list, empty for every fifth conversation."""
    return turns(spark, sf_dir).select(
        "row_ord",
        F.col("query").alias("question"),
        F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>"))
        .otherwise(F.array("answer"))
        .alias("answers"),
    )


def bitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th English with the k-th French document.

    Documents beyond the last of the smaller language have no partner; places of ids alone say which, and their texts stay.
    """
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "fr"))
    bucket = F.floor(F.col("doc_id") / F.lit(ordering.BUCKET_ROWS))
    place = lambda df: dense_position(df, [bucket], ["doc_id"], within=["lang"], out="row_ord")
    ids = stage(place(docs.select("doc_id", "lang")), "places")
    ends = ids.groupBy("lang").agg(F.max("row_ord").alias("end")).agg(F.min("end")).scalar()
    last = ids.filter(F.col("row_ord") <= ends).groupBy("lang").agg(F.max("doc_id").alias("last"))
    # At most two rows; a missing id stands before all others and takes its place.
    paired = docs.join(F.broadcast(last), "lang").filter(F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("last")))
    ranked = place(paired.select("doc_id", "lang", "text"))
    side = lambda lang: ranked.filter(F.col("lang") == lang).select("row_ord", F.col("text").alias(lang))
    return side("en").join(side("fr").hint("merge"), "row_ord")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three sources normalised and concatenated, with text ids."""
    return assign_text_ids(
        union_examples(
            spark,
            [
                normalize.normalize_sts(sts(spark, sf_dir), F.col("lang"), "docs", 0),
                normalize.normalize_triples(triples(spark, sf_dir), source_seq=1),
                normalize.normalize_bitext(bitext(spark, sf_dir), "en-fr", 2),
            ],
        )
    )


def staged_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same written once, for queries that read it several times."""
    return stage(examples(spark, sf_dir), "examples", compression="zstd")


def faulty_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples with one fault per residue of the row number."""
    base = examples(spark, sf_dir)
    kind = F.col("row_ord") % 10
    none = F.array().cast("array<string>")
    first_blank = F.transform("texts", lambda t, i: F.when(i == 0, F.lit(" \t ")).otherwise(t))
    return base.withColumns(
        {
            "task": F.when(kind == 0, F.lit("translation")).otherwise(F.col("task")),
            "texts": F.when(kind == 1, none).when(kind == 4, first_blank).otherwise(F.col("texts")),
            "roles": F.when(kind == 2, F.slice("roles", 1, 1))
            .when(kind == 3, F.transform("roles", lambda r: F.lit("narrator")))
            .otherwise(F.col("roles")),
        }
    ).drop("label", "text_ids")


def teacher(spark: SparkSession, sf_dir: str, ex: DataFrame, numbered: DataFrame) -> DataFrame:
    """Teacher vectors, chosen by the row number ``n`` of the text id.

    Document kind for every id; query kind for the query-prompted ones.  Vectors
    of one label count as not encoded yet, so that some texts lack one.
    """
    table_ = table(spark, sf_dir, "embeddings")
    count = table_.agg(F.count(F.lit(1))).scalar()
    vectors = table_.select("vec_id", F.col("embedding").alias("vec"))
    encoded = table_.filter(F.col("label") != MISSING_LABEL).select(F.col("vec_id").alias("base"), "embedding")
    doc = numbered.select("text_id", (F.col("n") % count).alias("base")).join(encoded, "base")
    prompted = query_prompted_texts(ex, numbered.withColumn("text", F.lit(""))).select("text_id")
    query = (
        doc.select("text_id", ((F.col("base") * 7 + 3) % count).alias("vec_id"))
        .join(prompted, "text_id")
        .join(vectors, "vec_id")
    )
    return doc.select("text_id", F.col("embedding").alias("vec"), F.lit("doc").alias("kind")).unionByName(
        query.select("text_id", "vec", F.lit("query").alias("kind"))
    )


def student(teacher_vectors: DataFrame) -> DataFrame:
    """Student vectors: the first half of the document vector, not of unit length."""
    return teacher_vectors.filter("kind = 'doc'").select(
        "text_id", F.slice("vec", 1, 32).alias("vec"), F.lit("doc").alias("kind")
    )


def without_roles(ex: DataFrame) -> DataFrame:
    """Every third sentence pair and parallel pair without sentence roles."""
    bare = F.col("task").isin("sts", "bitext") & (F.col("row_ord") % 3 == 0)
    return ex.withColumn("roles", F.when(bare, F.transform("roles", lambda r: F.lit("document"))).otherwise(F.col("roles")))


def corpus(
    spark: SparkSession, sf_dir: str, with_texts: bool = False, bare: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples, teacher, student), the first two written once; ``bare`` takes the roles of some pairs.

    Queries over ids, pairs and vectors do not carry the texts: they are left
    blank once the ids are computed.
    """
    ex = examples(spark, sf_dir)
    if bare:
        ex = without_roles(ex)
    if not with_texts:
        ex = ex.withColumn("texts", F.array_repeat(F.lit(""), F.size("text_ids")))
    ex = stage(ex, "examples", compression="zstd")
    ids = ex.select(F.explode("text_ids").alias("text_id")).distinct()
    vectors = stage(teacher(spark, sf_dir, ex, stage(row_numbers(ids, "n"), "ids")), "teacher")
    return ex, vectors, student(vectors)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as tokens of a text (their label); each fifth position is padding.

    Positions restart per label; the order key is cut into buckets like any other order.
    """
    vectors = table(spark, sf_dir, "embeddings")
    bucket = F.floor(F.col("vec_id") / F.lit(ordering.BUCKET_ROWS))
    placed = dense_position(vectors, [bucket], ["vec_id"], within=["label"], out="pos")
    return placed.select(
        F.col("label").alias("id"), "pos", (F.col("pos") % 5 != 0).alias("mask"), F.col("embedding").alias("vec")
    )


