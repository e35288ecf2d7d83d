"""Session defaults, the shared scratch folder, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session of our own. A session handed to us keeps what it has.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_shipped: set[str] = set()


def get_spark(app: str = "ridgeway", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that the launcher made."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that kernels import by name.

    The driver's file server hands it out; executors need no shared code folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ridgeway-"), "ridgeway_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    # Long texts: lower Spark's own bounds of an Arrow batch, unless the session says otherwise.
    for what, usual, ours in (("maxRecordsPerBatch", "10000", "1024"), ("maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{what}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{what}", ours)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or, in local mode only, one of our own where unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ridgeway-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ridgeway-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder; it survives lost executors."""
    return appended([df], name, **options)


def appended(parts: Iterable[DataFrame], name: str, **options: str) -> DataFrame:
    """`written` of the union of some tables, each made when those before it are written; one at least."""
    path, df = None, None
    for df in parts:
        path = path or fresh_path(df.sparkSession, name)
        df.write.mode("append").parquet(path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ridgeway_path = path
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files go when it ends, not when the driver happens to collect its garbage. For jobs that end in
    tables; a DataFrame that is run twice is computed twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_ridgeway_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
