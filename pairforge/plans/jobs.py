"""The four jobs of the product, each reading and writing tables in shared storage.

``build_corpus`` -> ``embed_corpus`` -> ``measure_alignment`` and ``evaluate_model``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairforge import constants as K
from pairforge.functions.prompts import Prompts
from pairforge.operators import batching, evaluate, metrics
from pairforge.operators.encode import EncoderFactory, corpus_texts, encode, encode_corpus
from pairforge.operators.keys import assign_text_ids, cap_examples, cap_texts, fetch_texts, text_uses
from pairforge.operators.lookup import attach_vectors
from pairforge.operators.membership import Membership
from pairforge.operators.skew import hot_keys_of
from pairforge.operators.validate import annotate, require_valid
from pairforge.session import stage, staged_in
from pairforge.sources import tables
from pairforge.sources.catalogue import Source, load_examples, with_fallback


def build_corpus(
    spark: SparkSession,
    root: str,
    catalogue: Sequence[Source],
    out: str,
    *,
    max_unique: int | None = None,
    per_shard: int = K.DEFAULT_EXAMPLES_PER_SHARD,
    quarantined: bool = False,
) -> DataFrame:
    """Sources to example shards and unique texts; returns the summary row.

    Normalised examples are written once because counting, capping and
    splitting each read them again.  All unique texts are kept unless
    ``max_unique`` says how many.  An invalid example stops the job; with
    ``quarantined`` it goes to ``rejected`` with its error instead, and the numbers
    of examples by error to ``errors``.
    """
    with staged_in(spark, "build"):
        loaded = with_fallback(load_examples(spark, root, catalogue))
        if quarantined:
            checked = stage(annotate(loaded), "checked")
            tables.write_report(checked.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("n")), f"{out}/errors")
            checked.filter(F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{out}/rejected")
            valid = checked.filter(F.col("error").isNull()).drop("error")
        else:
            valid = require_valid(loaded)
        examples = stage(assign_text_ids(valid), "examples")
        if max_unique is None:
            kept_uses, kept = text_uses(examples), examples
        else:
            # Counting positions and writing shards both read the kept examples; only kept texts are fetched.
            uses = stage(text_uses(examples), "uses")
            kept_uses = cap_texts(uses, max_unique)
            kept = stage(cap_examples(examples, uses, max_unique), "kept")
        tables.write_texts(fetch_texts(kept_uses, examples), f"{out}/texts")
        tables.write_shards(kept, f"{out}/examples", per_shard)
        summary = tables.build_summary(
            spark.read.parquet(f"{out}/examples"), tables.read_texts(spark, f"{out}/texts")
        )
        tables.write_report(summary, f"{out}/summary")
        return summary


def embed_corpus(
    spark: SparkSession,
    corpus: str,
    out: str,
    factory: EncoderFactory,
    prompts: Prompts | None = None,
    names: Mapping[str, str] | None = None,
    parts: int | None = None,
    **options,
) -> DataFrame:
    """Encode every unique text once, query-like ones a second time with their prompt.

    With ``parts`` the texts are encoded and written part by part, and a job that
    is run again goes on with the parts that are not finished.  ``options`` go to
    ``encode``.  Returns the metadata row, which is also kept beside the vectors
    together with ``names`` (of the model, say).
    """
    train, _ = tables.read_shards(spark, f"{corpus}/examples", "train")
    texts = tables.read_texts(spark, f"{corpus}/texts")
    if parts is None:
        tables.write_embeddings(encode_corpus(texts, train, factory, prompts, **options), out)
    else:
        chosen = corpus_texts(texts, train, prompts)
        tables.write_embedding_parts(chosen, out, parts, lambda some: encode(some, factory, **options))
    meta = tables.embedding_meta(tables.read_embeddings(spark, out))
    tables.write_embedding_meta(meta, out, **(names or {}))
    return meta


def measure_alignment(
    examples: DataFrame,
    teacher: DataFrame,
    student: DataFrame | EncoderFactory,
    *,
    seed: int = 0,
    epoch: int = 0,
    world: int = 1,
    batch_size: int = K.DEFAULT_BATCH_SIZE,
    max_texts: int = K.DEFAULT_TEXTS_PER_BATCH,
    settings: metrics.LossSettings = metrics.LossSettings(),
    parts: Sequence[str] = metrics.PARTS,
    prompts: Prompts | None = None,
    hot: Mapping | None = None,
) -> DataFrame:
    """Losses per step and rank of student vectors against teacher vectors.

    ``student`` is a table of vectors by text id, or an encoder for the prompted
    texts.  With a table only ids, roles and labels move until vectors are
    attached; texts are not read.  ``hot`` lists text ids with very many uses;
    left out, they are counted.
    """
    by_table = isinstance(student, DataFrame)
    if hot is None:
        hot = hot_keys_of(examples.select(F.explode("text_ids").alias("text_id")), "text_id")
    # Texts stay where they are: the hash of a prompted text stands for it until it is encoded.
    examples = examples.drop("texts") if by_table else batching.student_ids(examples, prompts)
    # Sides, positive and graded pairs all read the batches, so they are written once.
    capped = stage(
        capped_batches(
            examples.drop("texts"),
            teacher,
            seed=seed,
            epoch=epoch,
            world=world,
            batch_size=batch_size,
            max_texts=max_texts,
            hot=hot,
        ),
        "batches",
    )
    place = ["step", "rank", "local_idx"]
    sides = batching.batch_texts(capped, prompts)
    if by_table:
        refs = sides.select(*place, "text_id", "use_query")
        tables_by_column = {"t_vec": (teacher, "use_query"), "s_vec": (student, None)}
        vectors = attach_vectors(refs, tables_by_column, place, hot)
    else:
        encoded = encode(batching.student_texts(sides, examples, prompts), student, half=False)
        refs = sides.select(*place, "text_id", "use_query", "student_id")
        with_teacher = attach_vectors(refs, {"t_vec": (teacher, "use_query")}, place, hot)
        by_student = with_teacher.drop("text_id").withColumnRenamed("student_id", "text_id")
        # A hot text is hot under its prompted form as well.
        hot_students = hot_keys_of(sides.select(F.col("student_id").alias("text_id")), "text_id") if hot else {}
        vectors = attach_vectors(by_student, {"s_vec": (encoded, None)}, place, hot_students)
    return metrics.batch_losses(
        vectors,
        batching.positive_pairs(capped),
        batching.graded_pairs(capped),
        world=world,
        max_texts=max_texts,
        settings=settings,
        parts=parts,
    )


def capped_batches(
    examples: DataFrame,
    embeddings: DataFrame,
    *,
    seed: int = 0,
    epoch: int = 0,
    world: int = 1,
    batch_size: int = K.DEFAULT_BATCH_SIZE,
    max_texts: int = K.DEFAULT_TEXTS_PER_BATCH,
    hot: Mapping | None = None,
    members: Membership | None = None,
) -> DataFrame:
    """Batches after dropping ineligible examples and cutting to the text cap.

    Batches are formed first, so dropped examples leave smaller batches.  ``members``
    (``lookup.known_ids``) pays where many ids have no vector yet.  Texts, if the
    examples have them, join the finished batches and are shuffled once.
    """
    dealt = batching.assign_batches(
        examples.drop("texts"), seed=seed, epoch=epoch, world=world, batch_size=batch_size
    )
    capped = batching.cap_batch_texts(batching.eligible(dealt, embeddings, hot, members), max_texts)
    return batching.with_texts(capped, examples) if "texts" in examples.columns else capped


def evaluate_model(
    spark: SparkSession,
    corpus: str,
    factory: EncoderFactory,
    out: str,
    *,
    languages: Sequence[str] = K.ACTIVE_LANGUAGES,
    limit: int | None = None,
    model: str = "student",
    prompts: Prompts | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Evaluation report on the held-out split, or on everything when there is none.

    Every distinct prompted text is encoded once.  All retrieval examples are
    evaluated unless ``limit`` says how many; the report has both numbers.
    ``digits`` rounds similarities before they are ranked.
    """
    with staged_in(spark, "evaluate"):
        examples, fell_back = tables.read_shards(spark, f"{corpus}/examples", "val")
        pairs = evaluate.keyed_by_text(
            evaluate.sts_pairs(examples, languages, prompts), a_id="a_text", b_id="b_text"
        )
        chosen = evaluate.keyed_by_text(
            evaluate.retrieval_set(examples, limit, prompts), q_id="q_text", p_id="p_text"
        )
        texts = evaluate.texts_to_encode(
            (pairs, "a_id", "a_text"),
            (pairs, "b_id", "b_text"),
            (chosen, "q_id", "q_text"),
            (chosen, "p_id", "p_text"),
        )
        vectors = stage(encode(texts, factory, half=False), "eval-vectors")
        available = evaluate.retrieval_available(examples)
        report = report_for(pairs, chosen, vectors, languages, model, fell_back, digits, available)
        tables.write_report(report, out)
        # Read back, as the staged vectors go with the job.
        return spark.read.schema(report.schema).json(out)


def report_for(
    pairs: DataFrame,
    chosen: DataFrame,
    embeddings: DataFrame,
    languages: Sequence[str],
    model: str,
    fell_back: bool = False,
    digits: int | None = None,
    available: Column | None = None,
) -> DataFrame:
    """The report from sentence pairs, a retrieval set and unit vectors for both."""
    scored = evaluate.pair_similarity(pairs, embeddings)
    if digits is not None:
        scored = scored.withColumn("sim", F.round("sim", digits))
    # Ranks and counts by language both read them.
    vectors = stage(evaluate.retrieval_vectors(chosen, embeddings), "retrieval-vectors")
    ranks = evaluate.own_ranks(vectors, **({} if digits is None else {"digits": digits}))
    return evaluate.eval_report(
        evaluate.sts_report(scored, languages),
        evaluate.retrieval_metrics(ranks),
        evaluate.lang_counts(vectors),
        model,
        fell_back,
        available,
    )
