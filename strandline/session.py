"""Session helpers: a sized local session, tables by name, and shared scratch storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []


def local_session(cores: int = 8, name: str = "strandline", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's own session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master alone, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder. It is removed when the driver ends."""
    root = f"{shared_dir(spark)}/strandline-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append(root)
    return f"{root}/{tag}"


def _delete(spark: SparkSession, root: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for root in _scratch:
            _delete(spark, root)
    except Exception:  # the JVM may be gone before this process is
        pass


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch paths made inside go at its end: for work whose result was written elsewhere by then."""
    before = len(_scratch)
    try:
        yield
    finally:
        for root in _scratch[before:]:
            _delete(spark, root)
        del _scratch[before:]


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file whole or not at all, on the file system that Spark finds for its path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.part")
    out = fs.create(part, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(data[at : at + (1 << 20)])
    finally:
        out.close()
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"{part} can't be renamed to {place}")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path.rsplit("/", 1)[0]
    return out


def forget(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    root = getattr(df, "scratch", None)
    if root in _scratch:
        _delete(df.sparkSession, root)
        _scratch.remove(root)
