"""Files as rows: listings and Parquet footers, read by tasks.

Tasks reach files through Arrow's file systems, so one job covers any number of
sources and files, and whatever is wrong with one of them stays with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Schemes of paths that tasks can open, with Arrow's name for each.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme it has for Spark: its own, or that of the default file system."""
    if urlsplit(path).scheme:
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return default.rstrip("/") + "/" + path.lstrip("/") if not default.startswith("file:") else f"file:{path}"


def reachable(path: str) -> bool:
    """Whether tasks can open a qualified path."""
    return urlsplit(path).scheme in SCHEMES


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{quote(rest)}")


def opened(path: str):
    system, inside = system_of(path)
    return system.open_input_file(inside)


def data_files(path: str) -> list[str]:
    """Paths (inside the file system) that a reader would take: no names with a leading ``_`` or ``.``, of empty files none."""
    system, inside = system_of(path)
    found = system.get_file_info(inside)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [inside]
    below = system.get_file_info(fs.FileSelector(inside, recursive=True))
    hidden = lambda p: any(part[:1] in "_." and "=" not in part for part in p[len(inside) :].strip("/").split("/"))
    return [f.path for f in below if f.type == fs.FileType.File and f.size and not hidden(f.path)]


def _failure(error: Exception) -> str:
    return "PATH_NOT_FOUND" if isinstance(error, FileNotFoundError) else type(error).__name__


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seq, path in zip(batch["source_seq"].to_pylist(), batch["path"].to_pylist()):
            try:
                files, error = data_files(path), None
            except Exception as failure:  # noqa: BLE001  one source's failure is its status
                files, error = [], _failure(failure)
            n = max(len(files), 1)
            yield pa.RecordBatch.from_pydict(
                {"source_seq": pa.array([seq] * n, pa.int32()), "path": [path] * n, "file": pa.array(files or [None], pa.string()), "error": pa.array([error] * n, pa.string())}
            )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, errors = [], []
        for path, file, error in zip(*(batch[c].to_pylist() for c in ("path", "file", "error"))):
            n = 0
            if file is not None:
                try:
                    with system_of(path)[0].open_input_file(file) as source:
                        n = pq.read_metadata(source).num_rows
                except Exception as failure:  # noqa: BLE001  one file's failure is its source's status
                    error = _failure(failure)
            rows.append(n)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([batch["source_seq"], batch["file"], pa.array(rows, pa.int64()), pa.array(errors, pa.string())], ["source_seq", "file", "rows", "error"])


def footer_rows(spark: SparkSession, paths: Mapping[int, str]) -> DataFrame:
    """``source_seq, file, rows, error`` of every Parquet file of every source, from the footers alone.

    ``paths`` are qualified and reachable.  Sources are listed and footers read by
    tasks of one job; a source that cannot be listed is one row with its error.
    """
    given = spark.createDataFrame(list(paths.items()), "source_seq int, path string")
    listed = given.repartition("source_seq").mapInArrow(_listed, "source_seq int, path string, file string, error string")
    return listed.repartition("source_seq", "file").mapInArrow(_counted, "source_seq int, file string, rows long, error string")


def source_rows(spark: SparkSession, paths: Mapping[int, str]) -> DataFrame:
    """``source_seq, n_files, rows, error`` of each source; the rows are those of its readable files."""
    files = footer_rows(spark, paths)
    return files.groupBy("source_seq").agg(F.count("file").alias("n_files"), F.sum("rows").alias("rows"), F.max("error").alias("error"))
