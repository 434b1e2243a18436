"""Session helpers: reading tables, cutting lineage, releasing shuffle files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


#: Bytes of a table above which a local session spreads it over idle cores.
SPREAD = 4 << 20

#: Shuffle files of an action go when it ends, instead of when the driver's garbage happens to be collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spread(df: DataFrame, least: int = SPREAD) -> DataFrame:
    """``df`` over all cores of a local session if its files give fewer partitions; a cluster's tables are never moved for it."""
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local["):
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) < least or df.rdd.getNumPartitions() >= context.defaultParallelism:
        return df
    return df.repartition(context.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session may go without it; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="folioflow-")
    return _LOCAL[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there.

    A lost executor costs no recomputation beyond this point. The shuffle files that made ``df`` are deleted at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the folders behind frames that ``cut`` made, once nothing that is still to be computed reads them."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._cut_path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
