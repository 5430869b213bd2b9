"""Query-prompted texts and the pluggable batched encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairforge import constants as K
from pairforge.functions.prompts import Prompts, is_query_prompted
from pairforge.functions.vectors import to_lists, unit_rows
from pairforge.operators.keys import TEXT_ORDER, explode_sides, fetch_texts, text_uses
from pairforge.schemas import EMBEDDING, ORDER_KEY

# Called once per task (load the model there); turns a list of texts into an [n, dim] array.
Encoder = Callable[[Sequence[str]], np.ndarray]
EncoderFactory = Callable[[], Encoder]


def prompt_names(train: DataFrame) -> DataFrame:
    """``(text_id, prompt_name)`` of the texts that need a query-prompted vector.

    One row per text; of several prompts the last in example order wins.  Only
    ids and prompt names are shuffled, combined on the map side.
    """
    sides = explode_sides(
        train.select(*ORDER_KEY, "roles", "teacher_prompt_names", "text_ids"),
        "text_id",
        "role",
        "t_prompt",
    ).filter(is_query_prompted(F.col("role"), F.col("t_prompt")))
    return sides.groupBy("text_id").agg(
        F.max_by("t_prompt", F.struct(*TEXT_ORDER)).alias("prompt_name")
    )


def query_prompted_texts(
    train: DataFrame, texts: DataFrame, prompts: Prompts | None = None
) -> DataFrame:
    """Texts that need a query-prompted vector: ``(text_id, prompt_name, text)``.

    The text itself is joined by its unique id; ``prompted_examples`` fetches it
    from the examples instead.
    """
    prompts = prompts or Prompts()
    return prompt_names(train).join(texts.select("text_id", "text"), "text_id").select(
        "text_id",
        "prompt_name",
        prompts.teacher_text(F.col("prompt_name"), F.col("text")).alias("text"),
    )


def prompted_examples(train: DataFrame, examples: DataFrame, prompts: Prompts | None = None) -> DataFrame:
    """``query_prompted_texts`` of the texts of ``examples``: ids get their prompt before any text moves."""
    prompts = prompts or Prompts()
    texts = fetch_texts(text_uses(examples).join(prompt_names(train), "text_id"), examples)
    return texts.withColumn("text", prompts.teacher_text(F.col("prompt_name"), F.col("text"))).select("text_id", "prompt_name", "text")


# Texts that are ordered by length at a time, and their characters at most; one longer text is a pool of its own.
POOL_TEXTS, POOL_CHARS = 1 << 14, 1 << 25


def packed(lengths: np.ndarray, batch_size: int, budget: int | None) -> list[np.ndarray]:
    """Places of the texts of each batch, short with short.

    A batch has at most ``batch_size`` texts, and its texts times the length of its
    longest stay within ``budget``; a text beyond that is a batch of its own.
    """
    order = np.argsort(lengths, kind="stable")
    batches, first = [], 0
    while first < len(order):
        last = min(first + batch_size, len(order))
        if budget is not None:
            sizes = lengths[order[first:last]] * np.arange(1, last - first + 1)
            last = first + max(int(np.searchsorted(sizes, budget, "right")), 1)
        batches.append(order[first:last])
        first = last
    return batches


def _pools(batches: Iterator[pa.RecordBatch], length: Callable[[str], int]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Consecutive rows that are packed together, with their texts and lengths."""
    for batch in batches:
        first, texts, lengths, held = 0, [], [], 0
        for place, text in enumerate(batch.column("text")):
            value = text.as_py()
            if texts and (len(texts) >= POOL_TEXTS or held + len(value) > POOL_CHARS):
                yield batch.slice(first, len(texts)), texts, np.asarray(lengths, np.int64)
                first, texts, lengths, held = place, [], [], 0
            texts.append(value)
            lengths.append(length(value))
            held += len(value)
        if texts:
            yield batch.slice(first, len(texts)), texts, np.asarray(lengths, np.int64)


def encode(
    texts: DataFrame,
    factory: EncoderFactory,
    *,
    batch_size: int = K.DEFAULT_ENCODE_BATCH,
    budget: int | None = None,
    length: Callable[[str], int] = len,
    max_length: int | None = None,
    tasks: int | None = None,
    normalize: bool = True,
    half: bool = True,
    report: bool = False,
) -> DataFrame:
    """Encode ``(text_id, kind, text)`` to ``(text_id, vec, kind)`` in Arrow batches.

    The encoder is built once per task and sees whole texts.  Texts of similar
    length share a batch, as a model pads to the longest: ``length`` measures them
    (characters, or tokens of the model's tokenizer), ``max_length`` is where the
    model itself cuts, and ``budget`` bounds texts times longest length of a batch.
    Rows come out in the order they came in.  ``tasks`` deals the texts to so many
    tasks.  Vectors are scaled to unit length and rounded to half precision unless
    told otherwise.  ``report`` adds ``length`` and ``padded``, the length in its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for rows, values, lengths in _pools(batches, length):
            lengths = lengths if max_length is None else np.minimum(lengths, max_length)
            out, padded = None, np.zeros(len(values), np.int64)
            for places in packed(lengths, batch_size, budget):
                matrix = np.asarray(encoder([values[p] for p in places]), dtype=np.float64)
                if normalize:
                    matrix = unit_rows(matrix)
                if half:
                    matrix = matrix.astype(np.float32).astype(np.float16)
                if out is None:
                    out = np.zeros((len(values), matrix.shape[1]), np.float32)
                out[places] = matrix
                padded[places] = lengths[places].max()
            for start in range(0, len(values), batch_size):
                part = rows.slice(start, batch_size)
                columns = [part.column("text_id"), to_lists(out[start : start + batch_size]), part.column("kind")]
                if report:
                    columns += [pa.array(x[start : start + batch_size]) for x in (lengths, padded)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType(EMBEDDING.fields + [T.StructField(c, T.LongType()) for c in ("length", "padded")]) if report else EMBEDDING
    names = schema.names
    chosen = texts.select("text_id", "text", "kind")
    if tasks is not None:
        chosen = chosen.repartition(tasks, "text_id", "kind")
    return chosen.mapInArrow(run, schema)


def padding_share(encoded: DataFrame) -> DataFrame:
    """One row: texts and the share of padding in all their batches, from ``encode(..., report=True)``."""
    return encoded.agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("padded") - F.col("length")), F.sum("padded")).alias("padding")
    )


def in_part(parts: int) -> Column:
    """Number of the part that a text belongs to, by its id."""
    return F.pmod(F.xxhash64("text_id"), F.lit(parts)).cast("int")


def _by_kind(texts: DataFrame, prompts: Prompts | None) -> DataFrame:
    """``(text_id, text, kind)`` of texts with their ``prompt_name``: each as it is, and prompted where there is one."""
    as_kind = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).alias("kind"))
    name, text = F.col("prompt_name"), F.col("text")
    query = F.when(name.isNotNull(), as_kind((prompts or Prompts()).teacher_text(name, text), "query"))
    kinds = F.explode(F.array_compact(F.array(as_kind(text, "doc"), query)))
    return texts.select("text_id", kinds.alias("_k")).select("text_id", "_k.text", "_k.kind")


def corpus_texts(texts: DataFrame, train: DataFrame, prompts: Prompts | None = None) -> DataFrame:
    """``(text_id, text, kind)`` to encode: all texts, and the query-prompted ones a second time."""
    return _by_kind(texts.select("text_id", "text").join(prompt_names(train), "text_id", "left"), prompts)


def example_texts(examples: DataFrame, prompts: Prompts | None = None) -> DataFrame:
    """``corpus_texts`` of the distinct texts of ``examples``: ids get their prompt before any text moves."""
    named = text_uses(examples).join(prompt_names(examples), "text_id", "left")
    return _by_kind(fetch_texts(named, examples), prompts)


def encode_corpus(
    texts: DataFrame,
    train: DataFrame,
    factory: EncoderFactory,
    prompts: Prompts | None = None,
    **options,
) -> DataFrame:
    """Document vectors of all texts plus query vectors of the query-prompted ones."""
    return encode(corpus_texts(texts, train, prompts), factory, **options)
