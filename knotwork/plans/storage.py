"""Intermediate tables in the cluster's shared folder: they end lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="knotwork-")
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended: the folder then goes with the cluster's own cleaning
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/knotwork-{what}-{uuid.uuid4().hex}"
    _made.append(path)
    atexit.register(remove, spark, path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove all scratch tables so far, for a long session that needs none of its results any more."""
    while _made:
        remove(spark, _made.pop())


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, what: str, column: str) -> DataFrame:
    """As ``cut``, dealt into buckets by ``column``: joins on it and groups by it do not shuffle these rows again."""
    spark = df.sparkSession
    path = scratch(spark, what)
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    atexit.register(_dropped, spark, name)
    return spark.table(name)


def _dropped(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        spark.sql(f"DROP TABLE IF EXISTS {name}")
