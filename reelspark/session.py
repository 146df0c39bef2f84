"""Session helpers: one place for the settings and shared folders the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution, for tests, the benchmark and interactive use."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets a folder of its own, so that checkpoint()
    and written intermediate tables go to the same place; on a cluster, where no
    folder of one machine will do, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not root:
        known = jsc.getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="reelspark-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for one intermediate table."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df):
    """Reliable checkpoint: the rows go to the shared folder and lineage ends there."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df):
    """df dealt to all cores if it is a plain scan with fewer partitions than there are (one file of one row group, say); else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString() or run.toRdd().getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)


ARROW_LIMIT, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session get ARROW_BYTES and a row at most, or its own limit where that is less.

    Spark holds a batch several times over, in buffers off the heap that grow by
    doubling; those of 10,000 long texts make up a good part of an executor.
    """
    own = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if own > ARROW_BYTES:
        spark.conf.set(ARROW_LIMIT, str(ARROW_BYTES))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, wherever the driver was started; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="reelspark-")) / "reelspark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
