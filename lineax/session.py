"""Session helpers.

Library code never creates a session; it receives one (or a DataFrame) and
only reads its settings.  ``local_session`` is for tests, the bench and the
stand-in queries on one machine.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
from collections.abc import Callable

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lineax") -> SparkSession:
    """A local session with the settings the library assumes (ANSI on, UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LINEAX_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is configured.

    On a cluster the folder must be shared storage named by ``spark.checkpoint.dir``;
    a machine-local fallback is only allowed for ``local[...]`` masters (tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running lineax jobs")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lineax-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


#: Shuffle files of a query go as it ends, not when the driver next collects its garbage (Spark 4.1 on; others don't read it).
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for tables written mid-job."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage", partition_by: list[str] | None = None):
    """Write ``df`` once as parquet under the checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of recomputing
    the plan) with a single job; ``Dataset.checkpoint`` would compute an
    un-cached plan twice (once to count, once to write).  ``partition_by`` lays
    the table out in one folder per key, so later filters on that key read only
    their folder.  Nothing reads the job's shuffle files once the table is there,
    so they are removed with it: a chain of tables needs the disk of its largest step.
    """
    path = scratch_path(df.sparkSession, name)
    _write(df, path, partition_by)
    if not partition_by:
        return df.sparkSession.read.parquet(path)
    # The schema keeps partition columns' types (no inference from folder names).
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def materialize_parts(parts, name: str = "stage"):
    """The union of ``parts`` as one written table.  They are written one after the other, each without the
    shuffle files of those before, so the job needs the disk of the largest part's shuffle."""
    paths = []
    for df in parts:
        paths.append(scratch_path(df.sparkSession, name))
        _write(df, paths[-1])
    return df.sparkSession.read.schema(df.schema).parquet(*paths)


def read_alone(build: Callable):
    """``build()``, whose plan reads some of the tables written on the way; the others go.

    A long job needs the disk of one step's tables, not of all its steps'.  Nothing else that
    ``build`` made may be read later, and what it returns has no subquery (those are not seen).
    """
    made: list[str] = []
    _BUILDS.made = [*getattr(_BUILDS, "made", []), made]
    try:
        out = build()
    finally:
        _BUILDS.made = _BUILDS.made[:-1]
    read = {part for file in out.inputFiles() for part in file.split("/")}
    sc = out.sparkSession.sparkContext
    for path in made:
        if path.rsplit("/", 1)[1] not in read:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return out


def written_alone(build: Callable, name: str = "stage"):
    """``build()`` as a written table; the tables that were written on the way to it go as soon as it is there."""
    return read_alone(lambda: materialize(build(), name))


#: Tables written so far within the thread's calls of ``read_alone``, a list for each of them.
_BUILDS = threading.local()


def _write(df, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)
    for made in getattr(_BUILDS, "made", []):
        made.append(path)
