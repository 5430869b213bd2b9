"""Session settings and the one place that cuts lineage.

``stage`` writes a frame as Parquet below the shared folder the cluster names
in ``spark.checkpoint.dir`` and reads it back: columnar, prunable, with
statistics, and safe against lost executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession

from pairforge.sources.files import qualified, reachable, system_of


def local_session(cores: str = "*", app: str = "pairforge", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the given one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is set, a fresh folder serves in local mode; on a cluster that is
    an error, as executors would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="pairforge-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_JOB_FOLDER: ContextVar[str | None] = ContextVar("job folder", default=None)


@contextmanager
def staged_in(spark: SparkSession, name: str = "job") -> Iterator[str]:
    """Put everything staged inside below one folder, and delete that at the end.

    What a job gives back must not read staged frames any more.  An inner job uses
    the folder of the outer one.  Where tasks cannot reach the storage by themselves
    the folder is left to the cluster's clean-up.
    """
    outer = _JOB_FOLDER.get()
    if outer:
        yield outer
        return
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    token = _JOB_FOLDER.set(folder)
    try:
        yield folder
    finally:
        _JOB_FOLDER.reset(token)
        path = qualified(spark, folder)
        if reachable(path):
            system, inside = system_of(path)
            if system.get_file_info(inside).type == FileType.Directory:
                system.delete_dir(inside)


def stage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the frame read back; ``options`` go to the Parquet writer."""
    spark = df.sparkSession
    path = f"{_JOB_FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
