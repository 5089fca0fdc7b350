"""Session settings and the durable cut used by the iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Paths that ``cut`` wrote and nobody has deleted yet.
_WRITTEN: list[str] = []
# Where the table lies that ``cut`` gave back.
_PATHS: dict[int, str] = {}


def local_session(cores: str | int = "*", app: str = "lakewarden", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for durable intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master falls back to a folder of
    its own, because there driver and executors share one disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="lakewarden-checkpoint-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan restarts from files that outlive any executor, and the rows are computed once (a plain
    ``checkpoint()`` computes them twice unless they are cached first).
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/lakewarden/{tag}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _WRITTEN.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(back)] = path
    return back


def uncut(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that no later step reads."""
    for table in tables:
        path = _PATHS.pop(id(table))
        _delete(table.sparkSession, path)
        _WRITTEN.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what ``cut`` wrote since entering; results must have been written by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[before:]:
            _delete(spark, path)
        del _WRITTEN[before:]
