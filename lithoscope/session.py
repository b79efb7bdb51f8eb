"""Session helpers: a local session for tests and the bench, and the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("lithoscope")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once a session (as ``--py-files`` would)."""
    context = spark.sparkContext
    if not getattr(context, "_lithoscope_shipped", False):
        top = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="lithoscope-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, file.relative_to(top.parent))
        context.addPyFile(path)
        context._lithoscope_shipped = True
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt over tasks by a key, four a core: for slow work on the rows of a table of few files."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``, which driver and executors share, and read again: a short lineage.

    Where none is set, a local session gets a temporary one; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined()):
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lithoscope-"))
    return df.checkpoint(eager=True)
