"""The source catalogue and its scans.

A source lives at ``<root>/<name with / as __>[__config]/<split>.parquet``,
which may be one file or a folder of part files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from pairforge import constants as K
from pairforge.operators.normalize import normalize_source
from pairforge.schemas import EXAMPLE
from pairforge.session import stage
from pairforge.sources.files import qualified, reachable, source_rows


@dataclass(frozen=True)
class Source:
    group: str
    name: str
    lang: str = "en"
    split: str = "train"
    config: str | None = None
    max_examples: int | None = None
    max_negatives: int | None = None

    def path(self, root: str) -> str:
        folder = self.name.replace("/", "__")
        if self.config:
            folder = f"{folder}__{self.config}"
        return f"{root.rstrip('/')}/{folder}/{self.split}.parquet"


def default_catalogue() -> list[Source]:
    return [
        Source(group, name, lang, split, config, rows, negatives)
        for group, name, lang, split, config, rows, negatives in K.DEFAULT_CATALOGUE
    ]


def catalogue_from_config(config: dict) -> list[Source]:
    """Catalogue in group order from a ``datasets`` mapping of lists."""
    datasets = config.get("datasets") or {}
    fallback_lang = {"bitext": "en-ko"}
    return [
        Source(
            group,
            entry["name"],
            entry.get("lang", fallback_lang.get(group, "en")),
            entry.get("split", "train"),
            entry.get("config"),
            entry.get("max_examples"),
            entry.get("max_negatives"),
        )
        for group in ("sts", "retrieval", "bitext")
        for entry in datasets.get(group) or []
    ]


def _plain(path: str) -> str:
    """A path whose name may hold characters that readers take for a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_plain(path))


def _scan(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return _read(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# Files up to which their row offsets (16 bytes each) are broadcast.
BROADCAST_FILES = 4_000_000


def _file_offsets(df: DataFrame) -> DataFrame:
    """_path, _file (a 64-bit hash of it) and _start, the number of rows in the files before it in order of their paths.

    A row per file, counted without reading a column; folders are ordered first,
    then the files of one folder, so no task orders all files.  Two paths of one
    hash are an error.
    """
    path = F.col("_metadata.file_path")
    counts = df.groupBy(path.alias("_path")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_folder", F.regexp_replace("_path", "/[^/]*$", ""))
    folders = counts.groupBy("_folder").agg(F.sum("_n").alias("_total"))
    earlier = W.orderBy("_folder").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("_folder").orderBy("_path").rowsBetween(W.unboundedPreceding, -1)
    before = folders.select("_folder", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    start = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    return counts.join(before, "_folder").select("_path", F.xxhash64("_path").alias("_file"), start.alias("_start"))


def _unlike(offsets: DataFrame) -> DataFrame:
    """One row per _file; a hash of two files would give rows a wrong place."""
    one = F.when(F.count(F.lit(1)) == 1, F.max("_start")).otherwise(F.raise_error(F.lit("two file paths share a hash")).cast("long"))
    return offsets.groupBy("_file").agg(one.alias("_start"))


def _first_files(spark: SparkSession, df: DataFrame, path: str, offsets: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The scan and the offsets of the files that hold the first ``limit`` rows; at most ``limit`` of them have rows."""
    near = stage(offsets.filter(F.col("_start") < limit), "first-files")
    files = [unquote(urlsplit(row["_path"]).path) if row["_path"].startswith("file:") else unquote(row["_path"]) for row in near.select("_path").collect()]
    return spark.read.schema(df.schema).option("basePath", path).parquet(*[_plain(f) for f in files]), near


def scan_source(
    spark: SparkSession, root: str, source: Source, limit: int | None = None
) -> DataFrame | None:
    """Scan with ``row_ord``, the row's position in the source; ``None`` when the path is missing.

    Positions come from the file order and the row index Parquet readers expose,
    so they are stable across retries.  Partition columns are kept.  Rows find
    the offset of their file in a broadcast table of 16 bytes a file, so none is
    shuffled to reach its position; beyond ``BROADCAST_FILES`` files Spark joins as
    it sees fit.  With a ``limit`` only the files that hold the first rows are read.
    """
    path = source.path(root)
    df = _scan(spark, path)
    if df is None:
        return None
    row = F.col("_metadata.row_index")
    n_files = len(df.inputFiles())
    if n_files <= 1:
        out = df.select("*", row.alias("row_ord"))
    else:
        offsets = _file_offsets(df)
        if limit is not None:
            df, offsets = _first_files(spark, df, path, offsets, limit)
        starts = _unlike(offsets)
        rows = df.select("*", F.xxhash64("_metadata.file_path").alias("_file"), row.alias("_row"))
        out = (
            rows.join(F.broadcast(starts) if n_files <= BROADCAST_FILES else starts, "_file")
            .withColumn("row_ord", F.col("_start") + F.col("_row"))
            .drop("_file", "_start", "_row")
        )
    return out if limit is None else out.filter(F.col("row_ord") < limit)


def load_examples(spark: SparkSession, root: str, catalogue: Sequence[Source]) -> DataFrame:
    """All recognised sources, capped, normalised and concatenated; order lives in the order key."""
    parts = []
    for seq, source in enumerate(catalogue):
        raw = scan_source(spark, root, source, source.max_examples)
        if raw is None:
            continue
        part = normalize_source(
            raw, source.group, source.name, source.lang, source.max_negatives, seq
        )
        if part is not None:
            parts.append(part)
    return union_examples(spark, parts)


def union_examples(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of normalised frames; an empty typed frame when there is none."""
    if not parts:
        return spark.createDataFrame([], EXAMPLE)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


MANIFEST = T.StructType(
    [
        T.StructField("source_seq", T.IntegerType()),
        T.StructField("group", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("config", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rows", T.LongType()),
    ]
)


def ingest_manifest(spark: SparkSession, root: str, catalogue: Sequence[Source]) -> DataFrame:
    """One row per source with its row count and status; one bad source does not stop the others.

    Row counts come from Parquet footers, read by tasks: one job for all sources
    and files.  A missing path, a file that is no Parquet and any other failure
    becomes the status of its source.  Sources on storage that tasks cannot open by
    themselves are counted one by one with Spark.  Ingest keeps twice the later cap
    as headroom.
    """
    paths = {seq: qualified(spark, source.path(root)) for seq, source in enumerate(catalogue)}
    within = {seq: path for seq, path in paths.items() if reachable(path)}
    counts = source_rows(spark, within).select("source_seq", "rows", "error")
    others = [(seq, *_counted_alone(spark, path)) for seq, path in paths.items() if seq not in within]
    if others:
        counts = counts.unionByName(spark.createDataFrame(others, "source_seq int, rows long, error string"))
    entries = [(seq, s.group, s.name, s.config, s.split, s.lang, s.path(root), s.max_examples) for seq, s in enumerate(catalogue)]
    listed = spark.createDataFrame(
        entries, "source_seq int, `group` string, name string, config string, split string, lang string, path string, most long"
    )
    good = F.col("error").isNull()
    kept = F.least("rows", F.coalesce(2 * F.col("most"), F.col("rows")))
    told = listed.join(counts, "source_seq").withColumns(
        {
            "path": F.when(good, F.col("path")),
            "status": F.when(good, F.lit("ok")).otherwise(F.concat(F.lit("error: "), F.col("error"))),
            "rows": F.when(good, kept).otherwise(0),
        }
    )
    return told.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MANIFEST.fields])


def _counted_alone(spark: SparkSession, path: str) -> tuple[int, str | None]:
    try:
        return _read(spark, path).count(), None
    except Exception as error:  # noqa: BLE001  whatever stops one source must not stop the rest
        condition = error.getCondition() if isinstance(error, PySparkException) else None
        return 0, condition or type(error).__name__


def manifest_document(
    manifest: DataFrame, languages: Sequence[str] = K.ACTIVE_LANGUAGES, tasks: Sequence[str] = K.ACTIVE_TASKS
) -> DataFrame:
    """The manifest as one nested row for a report file; its entries are the catalogue's."""
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    entries = F.sort_array(F.collect_list(F.struct("source_seq", *[c for c in manifest.columns if c != "source_seq"])))
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return manifest.agg(entries.alias("datasets")).select(
        stamp.alias("created_at"),
        strings(languages).alias("languages"),
        strings(tasks).alias("tasks"),
        "datasets",
    )


def fallback_examples(spark: SparkSession) -> DataFrame:
    """The small fixed corpus that keeps later steps testable without sources."""
    rows = [(0, i, *row, None) for i, row in enumerate(K.FALLBACK_EXAMPLES)]
    return spark.createDataFrame(rows, EXAMPLE)


def with_fallback(examples: DataFrame) -> DataFrame:
    """The examples, or the fallback corpus when there is not a single one.

    Decided inside the plan: the fallback rows pass only if a one-row probe finds nothing.
    """
    probe = examples.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    spare = fallback_examples(examples.sparkSession).filter(probe == 0)
    return examples.unionByName(spare)
