"""Session settings and the shared folder where lineage is cut."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def local_session(cores: int | str = 8, name: str = "dissimap", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DISSIMAP_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set, else the context's checkpoint folder, else, of a local master only, one
    made here and removed at the end. Raises RuntimeError on a cluster that names none: a machine's own folder would lose rows."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="dissimap-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    sc.setCheckpointDir("file://" + d)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Tables of cut() not yet dropped, by application.
_made: dict[str, set[str]] = {}


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """df written as a table to the shared folder and read again: a plan without its lineage that a lost executor
    cannot invalidate. old: an earlier result of cut() that is no longer needed; its files are removed. clean() removes the others."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    if old is not None:
        drop(old)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    _made.get(sc.applicationId, set()).discard(path)


def drop(df: DataFrame) -> None:
    """Removes the files behind a result of cut()."""
    path = getattr(df, "_cut_path", None)
    if path:
        _remove(df.sparkSession, path)


def clean(spark: SparkSession) -> int:
    """Removes all tables of cut() made so far in this application, and returns their number. To be called between queries: results that were not
    written or collected can no longer be computed afterwards."""
    paths = sorted(_made.get(spark.sparkContext.applicationId, ()))
    for p in paths:
        _remove(spark, p)
    return len(paths)


def sql(spark: SparkSession, statement: str, **args) -> DataFrame:
    """spark.sql(), the statement being logged first, and its plan on level debug."""
    log.info("%s", statement)
    df = spark.sql(statement, **args)
    if log.isEnabledFor(logging.DEBUG):
        log.debug("%s", df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    return df


def input_partitions(df: DataFrame) -> int:
    """Partitions of df: of a scan, known without reading it."""
    return df.rdd.getNumPartitions()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once for each application."""
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as t:
        shutil.copytree(root, Path(t, "in", root.name), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(Path(tempfile.mkdtemp(), root.name)), "zip", Path(t, "in")))
