"""One-pass partitioning of a stream of vertices with their neighbours.

The stream is (v, nbrs ARRAY<BIGINT>); vertices go to shards by id, and each shard keeps in its state the parts of
the vertices that it has seen and the sizes of its parts. A vertex of a shard sees only what that shard has placed:
that is the price of not going through one task, and one shard is the exact rule. A vertex that comes again is
moved, as in a restream.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from knotwork.shipping import ship


def place(parts: dict[int, int], sizes: np.ndarray, v: int, nbrs: list[int], alpha: float, gamma: float) -> int:
    """The part of greatest neighbours less cost, the lowest of equal ones; state is changed in place."""
    k = len(sizes)
    known = [p for u in nbrs if (p := parts.get(u)) is not None]
    score = np.bincount(known, minlength=k) - alpha * (gamma / 2) * sizes ** (gamma - 1) if known else -(sizes ** (gamma - 1))
    to = int(np.argmax(score))
    if (old := parts.get(v)) is not None:
        sizes[old] -= 1
    sizes[to] += 1
    parts[v] = to
    return to


def partition_stream(adj: DataFrame, k: int, vertices: int, edges: int, gamma: float = 1.5, shards: int = 1) -> DataFrame:
    """(v, part) as the vertices arrive. vertices and edges are what is expected, for the cost's scale."""
    alpha = math.sqrt(2) * edges / max(1, vertices) ** gamma
    ship(adj.sparkSession)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, sizes = pickle.loads(state.get[0]) if state.exists else ({}, np.zeros(k))
        for rows in batches:
            rows = rows.sort_values("v")
            out = [place(parts, sizes, int(v), [int(u) for u in nbrs], alpha, gamma) for v, nbrs in zip(rows["v"], rows["nbrs"], strict=True)]
            yield pd.DataFrame({"v": rows["v"].to_numpy(), "part": np.array(out, "int32")})
        state.update((pickle.dumps((parts, sizes)),))

    keyed = adj.withColumn("shard", F.pmod("v", F.lit(shards)))
    return keyed.groupBy("shard").applyInPandasWithState(fold, "v long, part int", "held binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of a stream of events by tumbling windows, with a watermark for late rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")
