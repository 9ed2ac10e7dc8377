"""Session helpers: a builder with the settings that the plans expect, tables in the folder that all executors share, and shipping of this package to Python workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder (tests).
FALLBACK_DIR = "/tmp/checkpoints/noticeengine"

_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def build(master: str = "local[*]", partitions: int = 8, app: str = "noticeengine") -> SparkSession:
    """A session with adaptive execution and UTC; sizes are the caller's, since they follow the cluster."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without that setting FALLBACK_DIR, and only where all tasks run on this machine."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (conf.get("spark.master") or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return FALLBACK_DIR


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _path(spark, path)
    return system.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none where it is missing."""
    system, target = _path(spark, path)
    if not system.exists(target):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory())


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone: nothing is left to ask for the removal
            return


#: Removes an execution's shuffle files as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, compact: bool = False, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    compact is for tables that are large beside the input: they are written with zstd, and the shuffle
    files of the job that wrote them go when it ends instead of when the driver's memory is collected.
    by is a column of few values that later reads pick one of: each value's rows lie in a folder of their own.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    out = df.write.partitionBy(by) if by else df.write
    if compact:
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            out.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    else:
        out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def release(df: DataFrame | None) -> None:
    """Remove what materialize() wrote for df."""
    path = getattr(df, "_scratch_path", None)
    if path:
        drop_path(df.sparkSession, path)


def in_passes(spark: SparkSession, part: Callable[[int], DataFrame], passes: int, tag: str) -> DataFrame:
    """The union of part(0) .. part(passes - 1), each written before the next starts: only one part's shuffle is on disk at a time."""
    return reduce(DataFrame.unionByName, [materialize(part(i), tag, compact=True) for i in range(passes)])


def ship(spark: SparkSession) -> None:
    """Give every executor this package's sources, once per application, so that Arrow functions can import it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="noticeengine-")) / "noticeengine.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
