"""Session helpers: one place for the settings every plan here relies on, and for shared scratch space."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
LOCAL_SCRATCH = "/tmp/boutframe-checkpoints"
#: Batches to Python workers stay small whatever the rows' length.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_shipped: set[str] = set()


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A single-machine session with the settings that the plans assume (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("boutframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def size_of(text: str) -> int:
    """A number or size as Spark's settings give it (``4m``, ``64MB``, ``2000``), in bytes or units."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it.

    It also lowers the session's limits of Arrow batches to those of ``ARROW``, on purpose: kernels here count on small batches.
    """
    for key, value in ARROW.items():
        if not 0 < size_of(spark.conf.get(key)) <= int(value):
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="boutframe-ship-")) / "boutframe_pkg.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir")
    if not given and not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/boutframe-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove the files of a table from :func:`materialize`, which nothing may read any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, name)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone already; a local scratch folder can still be removed
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            import shutil

            shutil.rmtree(local, ignore_errors=True)
