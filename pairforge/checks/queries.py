"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads whole tables and whole texts.  Doubles are rounded to six
places and long texts are compared by digest, as in the SQL counterparts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairforge.checks import fixtures as fx
from pairforge.functions.prompts import Prompts, effective_student_prompt, wants_query_vector
from pairforge.functions.text import in_language, strip
from pairforge.functions.vectors import l2_normalize, round_to_half
from pairforge.operators import batching, encode, evaluate, keys, lookup, metrics, normalize
from pairforge.operators import ordering, pooling, registry, validate
from pairforge.plans import jobs
from pairforge.schemas import ORDER_KEY
from pairforge.session import shared_dir
from pairforge.sources import catalogue, tables

# Settings shared with the SQL side.
MAX_UNIQUE = 300
PER_SHARD = 50
SOURCE_CAP = 150
BATCH = {"seed": 7, "epoch": 1, "world": 2, "batch_size": 8, "max_texts": 24}
LANGUAGES = ("en", "fr")
SIM_DIGITS = 9
RETRIEVAL = 512  # size of the retrieval evaluation, first examples in order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[f"q_{fn.__name__}"] = fn
    return fn


def r6(value: str | Column) -> Column:
    return F.round(value, 6)


def digest(value: str | Column) -> Column:
    return F.md5(value)


def flat(examples: DataFrame) -> DataFrame:
    """Examples with lists as joined strings and texts as one digest."""
    joined = lambda c: F.array_join(c, ",")
    return examples.select(
        F.col("source_seq").cast("long").alias("source_seq"),
        "row_ord",
        "example_id",
        "task",
        "lang",
        F.size("texts").cast("long").alias("n_texts"),
        digest(F.array_join("texts", "|")).alias("texts_md5"),
        joined("roles").alias("roles"),
        joined("teacher_prompt_names").alias("teacher"),
        joined("student_prompt_names").alias("student"),
        "label",
    )


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def long_key(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select(F.col("source_seq").cast("long").alias("source_seq"), "row_ord", *more)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_source(sf_dir: str, table: str, group: str, **settings) -> tuple[str, catalogue.Source]:
    """A given table as a catalogued source: its folder is the name, its file the split."""
    root, _, name = sf_dir.rstrip("/").rpartition("/")
    return root, catalogue.Source(group, name, split=table, **settings)


# ------------------------------------------------------------- sources, ingest


@query
def source_cap(spark, sf_dir):
    """Scan of a named source with its order key and per-source cap."""
    root, source = table_source(sf_dir, "documents", "sts", max_examples=SOURCE_CAP)
    return catalogue.scan_source(spark, root, source, source.max_examples).select(
        "row_ord", "doc_id", "lang", digest("text").alias("text_md5")
    )


@query
def ingest_manifest(spark, sf_dir):
    """Row counts and status per source, headroom cap included; one source is missing."""
    root, docs = table_source(sf_dir, "documents", "sts", max_examples=SOURCE_CAP)
    entries = [docs] + [
        table_source(sf_dir, name, group)[1]
        for name, group in (("conversations", "retrieval"), ("labels", "sts"), ("absent", "bitext"))
    ]
    return catalogue.ingest_manifest(spark, root, entries).select(
        F.col("source_seq").cast("long").alias("source_seq"),
        F.col("group").alias("source_group"),
        "split",
        "lang",
        "rows",
        F.split_part("status", F.lit(":"), F.lit(1)).alias("status"),
        F.col("path").isNotNull().alias("has_path"),
    )


@query
def build_corpus(spark, sf_dir):
    """The build job from named sources to shards, texts and summary."""
    root, docs = table_source(sf_dir, "documents", "bitext", lang="en-ko")
    _, conv = table_source(sf_dir, "conversations", "bitext", lang="en-ko")
    _, absent = table_source(sf_dir, "absent", "bitext", lang="en-ko")
    summary = jobs.build_corpus(spark, root, [docs, absent, conv], scratch(spark, "corpus"))
    return _joined_summary(summary)


def _joined_summary(summary: DataFrame) -> DataFrame:
    return summary.select(
        "n_examples",
        "n_texts",
        F.array_join("languages", ",").alias("languages"),
        F.array_join("tasks", ",").alias("tasks"),
    )


# ----------------------------------------------------- normalise and validate


@query
def norm_sts(spark, sf_dir):
    return flat(normalize.normalize_sts(fx.sts(spark, sf_dir), F.col("lang"), "docs", 0))


@query
def norm_triples(spark, sf_dir):
    return flat(normalize.normalize_triples(fx.triples(spark, sf_dir), source_seq=1))


@query
def norm_passages(spark, sf_dir):
    return flat(normalize.normalize_passages(fx.passages(spark, sf_dir), "en", source_seq=1))


@query
def norm_qa(spark, sf_dir):
    return flat(normalize.normalize_answers(fx.answers(spark, sf_dir), "en", 1))


@query
def norm_bitext(spark, sf_dir):
    return flat(normalize.normalize_bitext(fx.bitext(spark, sf_dir), "en-fr", 2))


@query
def strip_text(spark, sf_dir):
    """Unicode strip of padded whole texts."""
    pad = F.lit(" \t\x1f  ")
    docs = fx.table(spark, sf_dir, "documents")
    clean = strip(F.concat(pad, F.col("text"), pad))
    return docs.select("doc_id", F.length(clean).cast("long").alias("n"), digest(clean).alias("text_md5"))


@query
def union_routed(spark, sf_dir):
    """Five sources through the router, concatenated and counted."""
    parts = [
        normalize.normalize_source(df, group, name, lang, cap, seq)
        for seq, (df, group, name, lang, cap) in enumerate(
            [
                (fx.sts(spark, sf_dir), "sts", "team/docs", F.col("lang"), None),
                (fx.triples(spark, sf_dir), "retrieval", "team/msmarco-turns", "en", 2),
                (fx.passages(spark, sf_dir), "retrieval", "team/miracl-turns", "en", 1),
                (fx.answers(spark, sf_dir), "retrieval", "team/mr-tydi-turns", "en", None),
                (fx.bitext(spark, sf_dir), "bitext", "team/pairs", "en-fr", None),
            ]
        )
    ]
    return (
        catalogue.union_examples(spark, parts)
        .groupBy(F.col("source_seq").cast("long").alias("source_seq"), "task", "lang")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("texts")).alias("n_texts"))
    )


@query
def validate_errors(spark, sf_dir):
    return validate.error_counts(fx.faulty_examples(spark, sf_dir))


@query
def quarantine(spark, sf_dir):
    """Rejected records with the first rule they break."""
    return long_key(validate.quarantine(fx.faulty_examples(spark, sf_dir))[1], "error")


@query
def accepted(spark, sf_dir):
    """Accepted records, with the optional fields filled in."""
    good = validate.quarantine(fx.faulty_examples(spark, sf_dir))[0]
    return long_key(good, "example_id", "label", F.col("text_ids").isNull().alias("no_ids"))


# ------------------------------------------------------ keys, caps and splits


@query
def unique_texts(spark, sf_dir):
    texts = keys.distinct_texts(fx.staged_examples(spark, sf_dir))
    return texts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("n_uses").alias("n_uses"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query
def distinct_texts(spark, sf_dir):
    texts = keys.distinct_texts(fx.staged_examples(spark, sf_dir))
    return long_key(
        texts, F.col("side").cast("long").alias("side"), "text_id", "lang", digest("text").alias("text_md5"), "n_uses"
    )


@query
def text_ids(spark, sf_dir):
    return long_key(fx.examples(spark, sf_dir), F.array_join("text_ids", ",").alias("text_ids"))


@query
def cap_texts(spark, sf_dir):
    ex = fx.staged_examples(spark, sf_dir)
    uses = fx.stage(keys.text_uses(ex), "uses")
    return keys.fetch_texts(keys.cap_texts(uses, MAX_UNIQUE), ex).select("text_id", "lang")


@query
def cap_examples(spark, sf_dir):
    ex = fx.staged_examples(spark, sf_dir)
    uses = fx.stage(keys.text_uses(ex), "uses")
    return long_key(keys.cap_examples(ex, uses, MAX_UNIQUE), "example_id")


@query
def split_shard(spark, sf_dir):
    shards = ordering.assign_shards(ordering.split_holdout(fx.staged_examples(spark, sf_dir)), PER_SHARD)
    return long_key(shards, "split", "pos", "shard")


@query
def summary(spark, sf_dir):
    ex = fx.staged_examples(spark, sf_dir)
    return _joined_summary(tables.build_summary(ex, keys.text_uses(ex)))


@query
def shard_roundtrip(spark, sf_dir):
    """Shards written and read back, per split; an unknown split falls back to all."""
    path = scratch(spark, "shards")
    tables.write_shards(fx.staged_examples(spark, sf_dir), path, PER_SHARD)
    parts = []
    for asked in ("train", "val", "test"):
        shards, fell_back = tables.read_shards(spark, path, asked)
        parts.append(
            shards.groupBy(
                F.lit(asked).alias("asked"), F.lit(fell_back).alias("fallback"), "split", "shard"
            ).agg(
                F.count(F.lit(1)).alias("n"),
                F.min("pos").alias("first_pos"),
                F.max("pos").alias("last_pos"),
                F.count("label").alias("n_labels"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def example_at(spark, sf_dir):
    """Random access by position: the fifth and the last training example."""
    path = scratch(spark, "shards")
    tables.write_shards(fx.staged_examples(spark, sf_dir), path, PER_SHARD)
    train, _ = tables.read_shards(spark, path, "train")
    last = train.agg(F.max("pos")).scalar()
    return long_key(train.filter(F.col("pos") == last).unionByName(tables.example_at(train, 4)), "pos", "example_id")


@query
def texts_roundtrip(spark, sf_dir):
    path = scratch(spark, "texts")
    tables.write_texts(keys.distinct_texts(fx.staged_examples(spark, sf_dir)), path)
    return tables.read_texts(spark, path).select("text_id", "lang", digest("text").alias("text_md5"))


@query
def checksums(spark, sf_dir):
    """Content digest of every shard of a written corpus, and whether its file holds together by its pieces."""
    path = scratch(spark, "shards")
    tables.write_shards(fx.staged_examples(spark, sf_dir), path, PER_SHARD)
    content = tables.content_digests(tables.read_shards(spark, path, "all")[0], ["split", "shard"], ["row_ord", "task", "texts", "roles", "text_ids"])
    # With more shards than writers a task has ``_run`` shards in a row, and its files count on.
    runs = content.groupBy("split").agg(F.ceil((F.max("shard") + 1) / F.lit(tables.WRITERS)).alias("_run"))
    files = tables.file_checksums(spark, path, piece_bytes=1 << 12)
    place = lambda pattern: F.regexp_extract("path", pattern, 1)
    named = files.select(
        place("split=([a-z]+)/").alias("split"),
        place("/part-([0-9]+)").cast("long").alias("_task"),
        place(r"\.c([0-9]+)\.[a-z.]*parquet$").cast("long").alias("_file"),
        ((F.ceil(F.col("bytes") / F.lit(1 << 12)) == F.col("pieces")) & (F.length("sha256") == 64)).alias("whole"),
    )
    shard = F.col("_task") * F.col("_run") + F.least(F.col("_file"), F.col("_run") - 1)
    named = named.join(F.broadcast(runs), "split").select("split", shard.alias("shard"), "whole")
    return content.join(named, ["split", "shard"])


@query
def fallback(spark, sf_dir):
    """Non-empty sources keep the fallback corpus out; an emptied one lets it in."""
    ex = fx.examples(spark, sf_dir)
    kept = catalogue.with_fallback(ex).select(F.lit("full").alias("source"), "task", "lang")
    emptied = catalogue.with_fallback(ex.filter(F.col("task") == "reranking"))
    return count_by(kept.unionByName(emptied.select(F.lit("empty").alias("source"), "task", "lang")), "source", "task", "lang")


@query
def stride(spark, sf_dir):
    """Rows dealt to three workers by position."""
    placed = ordering.example_position(fx.staged_examples(spark, sf_dir))
    dealt = ordering.stride(placed, 3).withColumn("rank", F.col("rank").cast("long"))
    return dealt.groupBy("rank", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


@query
def first_rows(spark, sf_dir):
    return long_key(ordering.first_rows(fx.examples(spark, sf_dir), 40), "example_id")


# ------------------------------------------------------------ prompts, registry


@query
def prompts(spark, sf_dir):
    """Teacher and student text of every side."""
    own = Prompts(student={"ret": "find: "})
    sides = keys.explode_sides(fx.examples(spark, sf_dir), "text", "role", "t_prompt", "s_prompt")
    student = effective_student_prompt(F.col("role"), F.col("s_prompt"))
    return long_key(
        sides,
        F.col("side").cast("long").alias("side"),
        student.alias("student_prompt"),
        digest(own.teacher_text(F.col("t_prompt"), F.col("text"))).alias("teacher_md5"),
        digest(own.student_text(student, F.col("text"))).alias("student_md5"),
    )


@query
def query_flags(spark, sf_dir):
    sides = keys.explode_sides(fx.examples(spark, sf_dir), "role")
    flag = wants_query_vector(F.col("task"), F.col("role"), F.col("side"))
    sides = sides.select("task", "role", F.col("side").cast("long").alias("side"), flag.alias("use_query"))
    return count_by(sides, "task", "role", "side", "use_query")


@query
def query_prompted(spark, sf_dir):
    """Query-prompted texts of the training split."""
    ex = fx.staged_examples(spark, sf_dir)
    train = ordering.split_holdout(ex).filter("split = 'train'")
    chosen = encode.prompted_examples(train, ex)
    return chosen.select("text_id", "prompt_name", digest("text").alias("text_md5"))


@query
def lang_filter(spark, sf_dir):
    ex = fx.examples(spark, sf_dir).filter(in_language(F.col("lang"), "e"))
    return count_by(ex, "task", "lang")


@query
def task_registry(spark, sf_dir):
    ex = registry.with_task_settings(fx.examples(spark, sf_dir))
    return count_by(ex, "task", "student_prompt", "teacher_prompt_query", "teacher_prompt_doc")


@query
def language_registry(spark, sf_dir):
    return count_by(registry.outside_languages(fx.examples(spark, sf_dir)), "lang")


# ---------------------------------------------------------- encode and vectors


def letter_encoder():
    """A deterministic stand-in for a model: counts of the 26 ASCII letters of the whole text."""

    def run(texts):
        counts = [np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) for t in texts]
        return np.stack(counts)[:, 97:123]

    return run


def _weighted(vec: str) -> Column:
    """A sum over all components, each with a weight of its own."""
    parts = F.transform(vec, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x), 4)


def _vector_probe(df: DataFrame, *keep: str) -> DataFrame:
    at = lambda i: r6(F.get("vec", F.lit(i)).cast("double"))
    return df.select(*keep, F.size("vec").cast("long").alias("dim"), _weighted("vec").alias("weighted"), at(0).alias("v0"), at(4).alias("v4"), at(19).alias("v19"))


@query
def encode_texts(spark, sf_dir):
    """Document and query vectors of every unique text, in half precision."""
    ex = fx.staged_examples(spark, sf_dir)
    vectors = encode.encode(encode.example_texts(ex), letter_encoder, budget=1 << 16)
    return _vector_probe(vectors, "text_id", "kind")


@query
def embed_job(spark, sf_dir):
    """The embedding job over a built corpus: its metadata row."""
    root, docs = table_source(sf_dir, "documents", "bitext", lang="en-ko")
    corpus = scratch(spark, "corpus")
    jobs.build_corpus(spark, root, [docs], corpus)
    return jobs.embed_corpus(spark, corpus, scratch(spark, "embeddings"), letter_encoder, parts=2)


@query
def normalize_vectors(spark, sf_dir):
    longer = F.transform("embedding", lambda x: (x.cast("double") * 3).cast("float"))
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", longer.alias("vec"))
    return _vector_probe(vectors.withColumn("vec", l2_normalize("vec")), "vec_id")


@query
def half_precision(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return _vector_probe(vectors.withColumn("vec", round_to_half("vec")), "vec_id")


def _long_vectors(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.posexplode("vec").alias("dim", "v")).select(
        "id", F.col("dim").cast("long").alias("dim"), r6(F.col("v").cast("double")).alias("value")
    )


@query
def mean_pool(spark, sf_dir):
    return _long_vectors(pooling.mean_pool(fx.tokens(spark, sf_dir)))


@query
def last_pool(spark, sf_dir):
    return _long_vectors(pooling.last_pool(fx.tokens(spark, sf_dir)))


@query
def row_numbers(spark, sf_dir):
    texts = fx.stage(keys.text_uses(fx.examples(spark, sf_dir)).select("text_id"), "ids")
    return lookup.row_numbers(texts)


@query
def vector_lookup(spark, sf_dir):
    """Vector of every side, query-prompted where the rule asks for it."""
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    sides = keys.explode_sides(ex, "text_id", "role")
    flag = wants_query_vector(F.col("task"), F.col("role"), F.col("side"))
    refs = long_key(sides, F.col("side").cast("long").alias("side"), "text_id", flag.alias("use_query"))
    found = lookup.lookup_vectors(refs, teacher, [*ORDER_KEY, "side"], use_query="use_query")
    return _vector_probe(found, "source_seq", "row_ord", "side", "text_id", "use_query")


@query
def overlay(spark, sf_dir):
    _, teacher, _ = fx.corpus(spark, sf_dir)
    at = lambda c, i: r6(F.get(c, F.lit(i)).cast("double"))
    return lookup.overlay(teacher).select(
        "text_id", _weighted("doc_vec").alias("doc_weighted"), _weighted("query_vec").alias("query_weighted"), at("doc_vec", 0).alias("doc0"), at("query_vec", 0).alias("query0"), at("query_vec", 63).alias("query63")
    )


@query
def vector_missing(spark, sf_dir):
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    refs = keys.explode_sides(ex, "text_id")
    gone = lookup.without_vector(refs, teacher, [*ORDER_KEY, "side"], members=lookup.known_ids(teacher))
    return long_key(gone, F.col("side").cast("long").alias("side"), "text_id")


@query
def vector_present(spark, sf_dir):
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    refs = keys.explode_sides(ex, "text_id")
    members = lookup.known_ids(teacher)
    return count_by(lookup.with_vector(refs, teacher, [*ORDER_KEY, "side"], members=members), "task", "lang")


@query
def embedding_roundtrip(spark, sf_dir):
    """Embeddings written by kind and read back; their metadata row."""
    _, teacher, _ = fx.corpus(spark, sf_dir)
    path = scratch(spark, "embeddings")
    tables.write_embeddings(teacher, path)
    return tables.embedding_meta(tables.read_embeddings(spark, path))


# ------------------------------------------------------------- batches, pairs


def _capped(ex: DataFrame, teacher: DataFrame) -> DataFrame:
    return jobs.capped_batches(ex, teacher, **BATCH)


@query
def batch_slots(spark, sf_dir):
    """Full batches before anything is dropped from them."""
    settings = {k: v for k, v in BATCH.items() if k != "max_texts"}
    dealt = batching.assign_batches(fx.staged_examples(spark, sf_dir), **settings)
    place = [F.col(c).cast("long").alias(c) for c in ("step", "rank", "slot")]
    return long_key(dealt, *place)


@query
def batches(spark, sf_dir):
    """Texts of every batch after eligibility and the text cap."""
    ex, teacher, _ = fx.corpus(spark, sf_dir, with_texts=True)
    rows = batching.batch_texts(_capped(ex, teacher))
    place = [F.col(c).cast("long").alias(c) for c in ("step", "rank", "local_idx", "side")]
    return long_key(rows, *place, "role", "text_id", digest("student_text").alias("student_md5"), "use_query")


def _pair_columns(pairs: DataFrame, *columns: str) -> DataFrame:
    return pairs.select(*[F.col(c).cast("long").alias(c) for c in columns])


@query
def positive_pairs(spark, sf_dir):
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    return _pair_columns(batching.positive_pairs(_capped(ex.drop("texts"), teacher)), "step", "rank", "i", "j")


@query
def sts_pairs(spark, sf_dir):
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    capped = jobs.capped_batches(ex.drop("texts"), teacher, members=lookup.known_ids(teacher), **BATCH)
    return _pair_columns(batching.graded_pairs(capped), "step", "rank", "i", "j")


@query
def pairs_without_roles(spark, sf_dir):
    """Pairs of both kinds where sentence and parallel pairs lack their roles: the first two texts, by label."""
    ex, teacher, _ = fx.corpus(spark, sf_dir, bare=True)
    capped = fx.stage(_capped(ex.drop("texts"), teacher), "batches")
    kinds = (("positive", batching.positive_pairs(capped)), ("graded", batching.graded_pairs(capped)))
    both = [_pair_columns(pairs, "step", "rank", "i", "j").withColumn("kind", F.lit(kind)) for kind, pairs in kinds]
    return both[0].unionByName(both[1])


@query
def global_pairs(spark, sf_dir):
    """Pairs of both kinds under global indices, block by block."""
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    capped = fx.stage(_capped(ex.drop("texts"), teacher), "batches")
    n = BATCH["max_texts"]
    both = [
        _pair_columns(
            batching.to_global(batching.within_batch(pairs, n, "i", "j"), n, gi="i", gj="j"), "step", "gi", "gj"
        ).withColumn("kind", F.lit(kind))
        for kind, pairs in (
            ("positive", batching.positive_pairs(capped)),
            ("graded", batching.graded_pairs(capped)),
        )
    ]
    return both[0].unionByName(both[1])


# -------------------------------------------------------------------- metrics


def _losses(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    ex, teacher, student = fx.corpus(spark, sf_dir)
    return jobs.measure_alignment(ex, teacher, student, parts=parts or metrics.PARTS, **BATCH)


def _per_step(losses: DataFrame, column: str) -> DataFrame:
    """A loss of the whole step, taken from its first rank."""
    first = F.min_by(column, "rank")
    return losses.groupBy("step").agg(r6(first).alias(column), F.max("n_valid").alias("n_valid"))


@query
def kl(spark, sf_dir):
    return _per_step(_losses(spark, sf_dir, "kl"), "loss_kl")


@query
def focal(spark, sf_dir):
    return _per_step(_losses(spark, sf_dir, "focal"), "loss_focal")


@query
def disperse(spark, sf_dir):
    return _per_step(_losses(spark, sf_dir, "disperse"), "loss_disp")


@query
def pair_mse(spark, sf_dir):
    losses = _losses(spark, sf_dir, "sts")
    return losses.select("step", F.col("rank").cast("long").alias("rank"), r6("loss_sts").alias("loss_sts"))


@query
def loss_bundle(spark, sf_dir):
    losses = _losses(spark, sf_dir)
    parts = [r6(c).alias(c) for c in ("loss_kl", "loss_focal", "loss_disp", "loss_sts", "loss")]
    return losses.select("step", F.col("rank").cast("long").alias("rank"), *parts, "n", "n_valid")


@query
def step_report(spark, sf_dir):
    report = metrics.step_report(_losses(spark, sf_dir), every=5)
    return report.select("step", r6("loss").alias("loss"), "n", "n_valid")


@query
def pairwise_cosine(spark, sf_dir):
    """Cosine matrix of vectors in groups of 64, reduced per row in tiles of 32."""
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 64).alias("step"), (F.col("vec_id") % 64).alias("idx"), F.col("embedding").alias("vec")
    )
    rows = metrics.pairwise_cosine(vectors, max_rows=64, tile_rows=32)
    return rows.select("step", "idx", "n", r6("total").alias("total"), r6("lowest").alias("lowest"), r6("highest").alias("highest"))


# ----------------------------------------------------------------- evaluation


def _scored(ex: DataFrame, vectors: DataFrame) -> DataFrame:
    scored = evaluate.pair_similarity(evaluate.sts_pairs(ex, LANGUAGES), vectors)
    return scored.withColumn("sim", F.round("sim", SIM_DIGITS))


@query
def sts_similarity(spark, sf_dir):
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    return long_key(_scored(ex, teacher), "lang", "label", r6("sim").alias("sim"))


@query
def sts_spearman(spark, sf_dir):
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    report = evaluate.sts_report(_scored(ex, teacher), (*LANGUAGES, "ko"))
    return report.select("lang", "n", r6("spearman").alias("spearman"), "low_sample")


@query
def retrieval_ranks(spark, sf_dir):
    """Rank of each query's own passage within the evaluation set."""
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    vectors = evaluate.retrieval_vectors(evaluate.retrieval_set(ex, RETRIEVAL), teacher)
    ranks = evaluate.own_ranks(vectors, block=64, digits=SIM_DIGITS)
    return ranks.select("i", "rank")


@query
def retrieval_eval(spark, sf_dir):
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    vectors = evaluate.retrieval_vectors(evaluate.retrieval_set(ex, RETRIEVAL), teacher)
    ranks = evaluate.own_ranks(vectors, digits=SIM_DIGITS)
    return evaluate.retrieval_metrics(ranks).select("n", r6("recall_at_1").alias("recall_at_1"), r6("mrr").alias("mrr"))


@query
def eval_lang_counts(spark, sf_dir):
    return evaluate.lang_counts(evaluate.retrieval_set(fx.examples(spark, sf_dir), RETRIEVAL))


def _flat_report(report: DataFrame) -> DataFrame:
    counts = F.transform("retrieval.by_lang", lambda x: F.concat_ws("=", x["lang"], x["n"].cast("string")))
    return report.select(
        "model",
        "fallback",
        F.explode("sts").alias("s"),
        F.col("retrieval.n").alias("queries"),
        F.col("retrieval.available").alias("available"),
        r6("retrieval.recall_at_1").alias("recall_at_1"),
        r6("retrieval.mrr").alias("mrr"),
        F.array_join(counts, ",").alias("by_lang"),
    ).select("model", "fallback", "s.lang", "s.n", r6("s.spearman").alias("spearman"), "s.low_sample", "queries", "available", "recall_at_1", "mrr", "by_lang")


@query
def eval_report(spark, sf_dir):
    """The nested report over all examples, written as JSON and read back."""
    ex, teacher, _ = fx.corpus(spark, sf_dir)
    report = jobs.report_for(
        evaluate.sts_pairs(ex, LANGUAGES), evaluate.retrieval_set(ex, RETRIEVAL), teacher, LANGUAGES, "student", digits=SIM_DIGITS,
        available=evaluate.retrieval_available(ex),
    )
    path = scratch(spark, "report")
    tables.write_report(report, path)
    return _flat_report(spark.read.schema(report.schema).json(path))


@query
def eval_job(spark, sf_dir):
    """The evaluation job on the held-out split with an encoder; sources take turns, so the split holds all tasks."""
    corpus = scratch(spark, "corpus")
    turns = F.col("row_ord") * 3 + F.col("source_seq")
    mixed = fx.staged_examples(spark, sf_dir).withColumns({"row_ord": turns, "source_seq": F.lit(0)})
    tables.write_shards(mixed, f"{corpus}/examples")
    report = jobs.evaluate_model(spark, corpus, letter_encoder, scratch(spark, "report"), languages=LANGUAGES, digits=SIM_DIGITS)
    return _flat_report(report)


@query
def encoder_losses(spark, sf_dir):
    """Alignment of an encoder's vectors of prompted texts with the teacher."""
    ex, teacher, _ = fx.corpus(spark, sf_dir, with_texts=True)
    losses = jobs.measure_alignment(ex, teacher, letter_encoder, **BATCH)
    parts = [r6(c).alias(c) for c in ("loss_kl", "loss_focal", "loss_disp", "loss_sts")]
    return losses.select("step", F.col("rank").cast("long").alias("rank"), *parts, "n_valid")
