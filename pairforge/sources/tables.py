"""Corpus tables on storage: example shards, texts, embeddings, reports, checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from pairforge import constants as K
from pairforge.functions.vectors import round_to_half
from pairforge.operators.encode import in_part
from pairforge.operators.ordering import assign_shards, split_holdout
from pairforge.schemas import EMBEDDING, EXAMPLE, ORDER_KEY, SHARD, TEXT
from pairforge.sources.files import opened


# In the order of their rows.
SPLITS = ("val", "train")
# Most tasks of one write; beyond it a task writes several shards in a row.
WRITERS = 10_000
# Of shards and texts: long texts repeat at distances beyond the window of lighter codecs.
COMPRESSION = "zstd"


def shard_bounds(examples: DataFrame, per_shard: int = K.DEFAULT_EXAMPLES_PER_SHARD) -> dict[str, pa.Table]:
    """For each split that has rows the first order key of every shard, in order: ``shard, source_seq, row_ord``.

    Positions are worked out on order keys alone.  One row per shard reaches the
    driver: 24 bytes for ``per_shard`` examples.
    """
    placed = assign_shards(split_holdout(examples.select(*ORDER_KEY)), per_shard)
    first = placed.filter(F.col("pos") % per_shard == 0).select("split", "shard", *ORDER_KEY).toArrow()
    bounds = {}
    for split in SPLITS:
        own = first.filter(pc.equal(first["split"], split)).drop_columns("split").sort_by("shard")
        if len(own):
            bounds[split] = own
    return bounds


def _shard_of(spark: SparkSession, bounds: pa.Table) -> Callable[..., Column]:
    """Column function from an order key to its shard: the last one that begins at or before it."""
    starts = [bounds[c].to_numpy() for c in ORDER_KEY]
    shared = spark.sparkContext.broadcast([np.asarray(x, np.int64) for x in starts])

    def find(source: pa.Array, row: pa.Array) -> pa.Array:
        seqs, rows = shared.value
        source, row = np.asarray(source, np.int64), np.asarray(row, np.int64)
        out = np.zeros(len(source), np.int64)
        for seq in np.unique(source):
            # Bounds of one source stand together; a key before the first of them belongs to the shard before.
            low, high = np.searchsorted(seqs, seq), np.searchsorted(seqs, seq, "right")
            mine = source == seq
            out[mine] = low + np.searchsorted(rows[low:high], row[mine], "right") - 1
        return pa.array(out)

    return F.arrow_udf(find, "long")


def write_shards(
    examples: DataFrame, path: str, per_shard: int = K.DEFAULT_EXAMPLES_PER_SHARD, writers: int | None = None
) -> None:
    """Split, number and write examples: ``split=<s>/part-<n>-...`` with at most ``per_shard`` rows a file.

    The n-th file of a split is its n-th shard; all shards of a split lie in one
    folder.  Bounds of shards come from the order keys, so rows are shuffled once,
    straight to the task of their shard, and every task writes its rows in order.
    With more shards than ``writers`` a task has several in a row and its files
    count on (``.c000``, ``.c001``).  An empty split leaves nothing.
    """
    bounds = shard_bounds(examples, per_shard)
    rows = examples.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EXAMPLE.fields])
    if not bounds:
        nothing = rows.limit(0).withColumns({"pos": F.lit(0).cast("long"), "shard": F.lit(0).cast("long"), "split": F.lit("")})
        nothing.write.mode("overwrite").partitionBy("split").parquet(path, compression=COMPRESSION)
    train = bounds.get("train")
    for split, mode in zip(bounds, ("overwrite", "append")):
        own = bounds[split]
        if train is not None and "val" in bounds:
            # The held-out rows come first, so the first training key parts the splits; the scan can skip by it.
            seq, row = (train[c][0].as_py() for c in ORDER_KEY)
            early = (F.col("source_seq") < seq) | ((F.col("source_seq") == seq) & (F.col("row_ord") < row))
            mine = rows.filter(early if split == "val" else ~early)
        else:
            mine = rows
        run = -(-len(own) // (writers or WRITERS))
        task = F.floor(_shard_of(rows.sparkSession, own)(*ORDER_KEY) / F.lit(run)).cast("int")
        # The folder column leads the sort, as the writer would sort by it otherwise.
        keyed = mine.withColumn("_task", task).withColumn("split", F.when(F.col("_task") >= 0, split))
        placed = keyed.repartitionById(-(-len(own) // run), F.col("_task")).sortWithinPartitions("split", *ORDER_KEY)
        # The low bits of the row id count the rows of a task, which begins at a shard's first row.
        ahead = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        numbered = placed.withColumn("pos", F.col("_task").cast("long") * run * per_shard + ahead)
        (
            numbered.select(*rows.columns, "pos", F.floor(F.col("pos") / F.lit(per_shard)).alias("shard"), "split")
            .write.mode(mode)
            .options(maxRecordsPerFile=per_shard, compression=COMPRESSION)
            .partitionBy("split")
            .parquet(path)
        )


def read_shards(spark: SparkSession, path: str, split: str = "train") -> tuple[DataFrame, bool]:
    """(examples of the split, fell back).  A missing split falls back to all shards.

    Only the split's folder is listed and read.
    """
    reader = spark.read.schema(SHARD).option("basePath", path)
    try:
        return reader.parquet(f"{path}/split={split}"), False
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    try:
        return reader.parquet(path), True
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no example shards in {path}") from error
        raise


def example_at(shards: DataFrame, index: int) -> DataFrame:
    """The example at a global index of a split: a pushed-down filter on the stored position."""
    return shards.filter(F.col("pos") == index)


def write_texts(texts: DataFrame, path: str) -> None:
    texts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TEXT.fields]).write.mode(
        "overwrite"
    ).parquet(path, compression=COMPRESSION)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEXT).parquet(path)


def iter_texts(texts: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time; the driver never holds more than one partition."""
    return texts.toLocalIterator(prefetchPartitions=False)


def _clustered(embeddings: DataFrame, files: int | None) -> DataFrame:
    """Embeddings hashed by text id and sorted inside each file.

    A range partitioning would run the plan once more to sample it, and that
    plan holds the encoder.
    """
    shape = [F.col(f.name).cast(f.dataType).alias(f.name) for f in EMBEDDING.fields]
    keys = [files, "text_id"] if files else ["text_id"]
    return embeddings.select(*shape).repartition(*keys).sortWithinPartitions("kind", "text_id")


def write_embeddings(embeddings: DataFrame, path: str, files: int | None = None) -> None:
    """Write ``(text_id, vec)`` below ``kind=doc`` and ``kind=query``."""
    _clustered(embeddings, files).write.mode("overwrite").partitionBy("kind").parquet(path)


def write_embedding_parts(texts: DataFrame, path: str, parts: int, encoder: Callable[[DataFrame], DataFrame], files: int | None = None) -> list[int]:
    """Encode and write ``(text_id, text, kind)`` part by part below ``kind=<k>/part=<n>``; returns the parts written.

    A part is a hash range of text ids.  A finished one leaves a mark and is passed
    over when the job is run again; an unfinished one is written anew, over
    whatever it left.
    """
    spark = texts.sparkSession
    done = {row["part"] for row in _marks_of_parts(spark, path, parts)}
    todo = [part for part in range(parts) if part not in done]
    for part in todo:
        vectors = _clustered(encoder(texts.filter(in_part(parts) == part)), files).withColumn("part", F.lit(part))
        (
            vectors.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("kind", "part")
            .parquet(path)
        )
        mark = spark.createDataFrame([(part, parts)], "part int, of int")
        mark.coalesce(1).write.mode("overwrite").json(f"{path}/_done/{part}-of-{parts}")
    return todo


def _marks_of_parts(spark: SparkSession, path: str, parts: int) -> list[Row]:
    try:
        marks = spark.read.schema("part int, of int").json(f"{path}/_done/*/*.json").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    if {row["of"] for row in marks} - {parts}:
        raise ValueError(f"{path} was begun with another number of parts")
    return marks


def save_embedding_table(embeddings: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The same as a catalogued table bucketed by text id.

    Lookups by text id then read the vectors where they lie: only refs are
    shuffled, epoch after epoch.
    """
    (
        _clustered(embeddings, buckets)
        .write.mode("overwrite")
        .option("path", path)
        .partitionBy("kind")
        .bucketBy(buckets, "text_id")
        .sortBy("text_id")
        .saveAsTable(table)
    )
    return embeddings.sparkSession.table(table)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """All embedding kinds; fails when the document part is missing."""
    try:
        spark.read.schema(EMBEDDING).option("basePath", path).parquet(f"{path}/kind=doc")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no document embeddings under {path}") from error
        raise
    return spark.read.schema(EMBEDDING).parquet(path).select(*EMBEDDING.names)


def embedding_meta(embeddings: DataFrame) -> DataFrame:
    """One row: number of texts, dimension, precision of the values and number of query vectors.

    The precision is read off the values: ``float16`` if half precision holds all of them.
    """
    is_doc = F.col("kind") == "doc"
    is_half = F.coalesce(F.every(round_to_half("vec") == F.col("vec")), F.lit(True))
    return embeddings.agg(
        F.count_if(is_doc).alias("n"),
        F.max(F.size("vec")).cast("long").alias("dim"),
        F.when(is_half, F.lit("float16")).otherwise(F.lit("float32")).alias("dtype"),
        F.count_if(~is_doc).alias("n_query"),
    )


def write_embedding_meta(meta: DataFrame, path: str, **names: str) -> None:
    """Keep the metadata beside the vectors, with names such as the model's, where readers of vectors pass it over."""
    write_report(meta.select("*", *[F.lit(v).alias(k) for k, v in names.items()]), f"{path}/_meta")


def read_embedding_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/_meta/*.json")


def build_summary(examples: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: counts and the sorted distinct languages and tasks.

    Languages and tasks are distinct values of small domains, deduplicated on the map side.
    """
    n_texts: Column = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return examples.agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.sort_array(F.collect_set("lang")).alias("languages"),
        F.sort_array(F.collect_set("task")).alias("tasks"),
    ).select("n_examples", n_texts.alias("n_texts"), "languages", "tasks")


def write_report(report: DataFrame, path: str) -> None:
    """Write a small report as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


# Bytes of a piece that one task digests, and that are read at once.
PIECE_BYTES, READ_BYTES = 1 << 28, 1 << 23


def _piece_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path, start, size in zip(*(batch[c].to_pylist() for c in ("path", "start", "bytes"))):
            state, left = hashlib.sha256(), size
            with opened(path) as file:
                file.seek(start)
                while left and (data := file.read(min(left, READ_BYTES))):
                    state.update(data)
                    left -= len(data)
            if left:
                raise OSError(f"{path} is shorter than it was listed")
            digests.append(state.hexdigest())
        yield batch.append_column("sha256", pa.array(digests, pa.string()))


def piece_checksums(spark: SparkSession, path: str, pattern: str = "*.parquet", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``path, piece, start, bytes, sha256`` of every piece of every file below ``path``.

    Files are listed without their content; each piece is a byte range that a
    task of its own reads in small steps, so neither a file nor a piece is ever
    held and one large file is spread over many tasks.  Empty files have no
    piece: Spark does not list them.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length")
    )
    last = F.ceil(F.col("length") / F.lit(piece_bytes)) - 1
    pieces = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * piece_bytes
    size = F.least(F.col("length") - start, F.lit(piece_bytes).cast("long"))
    ranges = pieces.select("path", "piece", start.alias("start"), size.alias("bytes")).repartition("path", "piece")
    return ranges.mapInArrow(_piece_digests, "path string, piece long, start long, bytes long, sha256 string")


def file_checksums(spark: SparkSession, path: str, pattern: str = "*.parquet", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``path, bytes, pieces, sha256`` of every file below ``path``.

    A file of one piece has its plain SHA-256, a longer one the SHA-256 of its
    pieces' digests in order; both depend on the bytes and ``piece_bytes`` alone.
    """
    pieces = piece_checksums(spark, path, pattern, piece_bytes)
    # One row of 64 characters for each piece of a file.
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "sha256"))), lambda p: p["sha256"]), "")
    files = pieces.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("pieces"), ordered.alias("_all"))
    root = F.when(F.col("pieces") == 1, F.col("_all")).otherwise(F.sha2(F.unhex("_all"), 256))
    return files.select("path", "bytes", "pieces", root.alias("sha256"))


def _spelled(value: Column, kind: T.DataType) -> Column:
    """A value as text that no other value of its type shares."""
    if isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: _spelled(x, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(parts, ""), F.lit("]"))
    else:
        plain = value.cast("string")
        text = F.concat(F.length(plain).cast("string"), F.lit(":"), plain)
    return F.coalesce(text, F.lit("-"))


def content_digests(rows: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``by``, the number of rows and a digest of their content that no order, file layout or codec changes.

    The digest is the sum of 60 bits of each row's MD5, so it combines before the
    shuffle; a row lost, repeated or altered changes it.  ``columns`` are of simple
    types or lists of them; left out, all that are not in ``by``.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    names = [c for c in kinds if c not in by] if columns is None else columns
    text = F.concat(*[_spelled(F.col(c), kinds[c]) for c in names])
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(number).cast("string").alias("digest"))
