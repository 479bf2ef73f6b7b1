"""Scratch tables in the cluster's shared folder, table readers, bounded Arrow slices and components.

Nothing here keeps state on one machine: intermediate tables are Parquet under ``spark.checkpoint.dir``,
so that a lost executor costs a rerun of its tasks only.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.plans.storage import cut, remove, shared_dir
from knotwork.shipping import ship

SLICE_BYTES = 1 << 18


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers.

    Batches of texts are kept at 8 MB (Spark's own 64 MB are held once by the JVM and twice by Python); a session
    that has set another size keeps it.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH, "67108864b") == "67108864b":
        spark.conf.set(BATCH, "8m")
    return df.mapInArrow(_tidied(run), schema)


def _tidied(run):
    """``run``, and then what its task has freed goes back to the system: workers live on from task to task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_by(df: DataFrame, what: str, column: str) -> DataFrame:
    """As ``cut``, dealt into buckets by ``column``: joins on it do not shuffle these rows again."""
    spark = df.sparkSession
    name = f"knotwork_{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    atexit.register(_dropped, spark, name, path)
    return spark.table(name)


def _dropped(spark: SparkSession, name: str, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove(spark, path)


def unused(columns: list[str], name: str) -> str:
    """A column name that ``columns`` do not hold, in any case of letters."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def text_slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``most`` bytes of ``column``, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    if col.buffers()[1] is None:
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the rows' offsets in them; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    offs = _offsets(col)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links as (node, label), label the smallest node reachable.

    Alternating large-star and small-star rounds; each ends when a round changes nothing. Every round is
    one grouped minimum (combined before the shuffle) and one join, written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = cut(edges, "links"), None
    for _ in range(64):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
