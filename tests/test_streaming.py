"""Streams give what a plain fold over the same rows gives."""

from __future__ import annotations

import numpy as np

from knotwork.streaming import partitioner


def test_stream_of_vertices(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(v, sorted({int(u) for u in r.integers(0, 40, 5)} - {v})) for v in range(40)]
    for k in range(2):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "v long, nbrs array<long>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v long, nbrs array<long>").parquet(str(tmp_path / "in"))
    out = partitioner.partition_stream(stream, 3, 40, 200)
    q = out.writeStream.format("memory").queryName("parts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {x["v"]: x["part"] for x in spark.table("parts").collect()}
    parts, sizes = {}, np.zeros(3)
    for v, nbrs in rows:
        partitioner.place(parts, sizes, v, nbrs, np.sqrt(2) * 200 / 40**1.5, 1.5)
    assert got == parts


def test_windowed_counts(spark):
    e = spark.createDataFrame([("2024-01-01 10:00:00", "view"), ("2024-01-01 12:00:00", "view"), ("2024-01-02 01:00:00", "view")], "ts string, event_type string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type")
    assert sorted(r["n"] for r in partitioner.windowed_counts(e).collect()) == [1, 2]
