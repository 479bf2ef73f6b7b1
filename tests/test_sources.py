"""Files: what is written is read back, and known texts are read right."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from knotwork.sources import formats


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return str(path)


@pytest.fixture
def a(spark):
    return spark.createDataFrame([(1, 2, 1.5), (3, 1, 2.0), (2, 2, -1.0)], "row long, col long, val double")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_matrix_market(spark, a, tmp_path):
    formats.write_matrix_market(a, str(tmp_path / "m"), 3, 3)
    assert rows(formats.read_matrix_market(spark, str(tmp_path / "m"))) == rows(a)
    p = write(tmp_path / "s.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n% c\n3 3 2\n2 1\n3 3\n")
    assert rows(formats.load(spark, p, expand=True)) == [(1, 2, 1.0), (2, 1, 1.0), (3, 3, 1.0)]
    p = write(tmp_path / "c.mtx", "%%MatrixMarket matrix coordinate complex hermitian\n2 2 1\n2 1 1.0 2.0\n")
    assert rows(formats.read_matrix_market(spark, p, expand=True)) == [(1, 2, 1.0, -2.0), (2, 1, 1.0, 2.0)]


def test_harwell_boeing(spark, tmp_path):
    text = "title key\n 3 1 1 1 0\nRUA 3 3 4 0\n(4I5) (4I5) (4E12.4)\n1 3 4 5\n1 3 2 3\n1.0 2.0D0 3.0 4.0\n"
    assert rows(formats.read_harwell_boeing(spark, write(tmp_path / "h.rua", text))) == [(1, 1, 1.0), (2, 2, 3.0), (3, 1, 2.0), (3, 3, 4.0)]


def test_triples_and_vectors(spark, a, tmp_path):
    b = a.withColumn("row", F.col("row") - 1).withColumn("col", F.col("col") - 1)
    formats.write_triples(b, str(tmp_path / "t"), 3, 3)
    head, m = formats.read_triples(spark, str(tmp_path / "t"))
    assert (head.rows, head.cols, head.entries) == (3, 3, 3) and rows(m) == rows(b)
    v = spark.createDataFrame([(0, 1.0), (3, 2.5)], "idx long, val double")
    formats.write_vector(v, str(tmp_path / "v"), 5)
    assert rows(formats.read_vector(spark, str(tmp_path / "v"))) == rows(v)
    assert formats.read_vector(spark, str(tmp_path / "v"), dense=True).count() == 5


def test_graph_files(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    formats.write_metis(e, str(tmp_path / "g"), 4)
    assert rows(formats.read_metis(spark, str(tmp_path / "g"))) == rows(e)
    assert rows(formats.read_metis(spark, write(tmp_path / "w.graph", "3 2 001\n2 5\n1 5 3 7\n2 7\n"))) == [(1, 2, 5.0), (2, 1, 5.0), (2, 3, 7.0), (3, 2, 7.0)]
    formats.write_pajek(e, str(tmp_path / "p"), 4)
    assert rows(formats.read_pajek(spark, str(tmp_path / "p"))) == rows(e)
    p = write(tmp_path / "xy.net", '*Vertices 2\n1 "a" 0.5 0.25 0.0\n2 "b c" 1 1 1\n*Arcs\n1 2 3\n')
    assert rows(formats.read_pajek_points(spark, p)) == [(1, 0.5, 0.25, 0.0), (2, 1.0, 1.0, 1.0)]
    assert rows(formats.read_snap(spark, write(tmp_path / "s.txt", "# c\n0\t1\n0\t1\n2\t0\n"))) == [(0, 1, 1), (2, 0, 1)]
    formats.write_dl_matrix(e, str(tmp_path / "dl"), 3)
    assert [r[0] for r in spark.read.text(str(tmp_path / "dl")).collect()][:4] == ["DL N=3", "format = fullmatrix", "data:", "0.0 1.0 0.0"]
    parts = spark.createDataFrame([(0, 1), (1, 0)], "v long, part int")
    formats.write_parts(parts, str(tmp_path / "parts"))
    assert rows(formats.read_parts(spark, str(tmp_path / "parts"))) == rows(parts)
    for k, writer in enumerate((formats.write_counted_edges, formats.write_tuple_graph, formats.write_cytoscape, formats.write_edges)):
        writer(e, str(tmp_path / f"w{k}"))
        assert spark.read.text(str(tmp_path / f"w{k}")).count() >= 4
    formats.write_dl_edges(e, str(tmp_path / "dle"), 3)
    formats.write_hypergraph(e.select(F.col("src").alias("row"), F.col("dst").alias("col"), "w"), str(tmp_path / "hg"), 4, 4)
    assert spark.read.text(str(tmp_path / "hg")).count() == 5


def test_typed_and_binary_edges(spark, tmp_path):
    p = write(tmp_path / "t.txt", "5 5 2\n1 2 1 3 2009-06-01 10:00:00\n2 3 0 0\n")
    got = formats.read_typed_edges(spark, p).orderBy("src").collect()
    assert [(r["src"], r["dst"], r["follower"], r["count"]) for r in got] == [(0, 1, True, 3), (1, 2, False, 0)]
    assert str(got[0]["latest"]) == "2009-06-01 10:00:00" and got[1]["latest"] is None
    formats.write_typed_edges(formats.read_typed_edges(spark, p), str(tmp_path / "tw"))
    p = write(tmp_path / "e.bin", struct.pack("<6q", 1, 2, -1, -1, 3, 4), "wb")
    assert rows(formats.read_edge_dump(spark, p)) == [(1, 2), (3, 4)]
    p = write(tmp_path / "e32.bin", struct.pack("<4i", 1, 2, 3, 4), "wb")
    assert rows(formats.read_edge_dump(spark, p, 32)) == [(1, 2), (3, 4)]
    head = b"HKDT" + struct.pack("<6Q", 1, 24, 0, 5, 6, 1)
    assert formats.parse_binary_header(head)["cols"] == 6
    assert rows(formats.read_binary_triples(spark, write(tmp_path / "m.bin", head + struct.pack("<qqd", 2, 3, 0.5), "wb"))) == [(2, 3, 0.5)]
    p = write(tmp_path / "te.bin", struct.pack("<ii?hq", 1, 2, True, 4, 86400), "wb")
    assert [(r["src"], r["dst"], r["follower"], r["count"]) for r in formats.read_typed_edge_records(spark, p).collect()] == [(0, 1, True, 4)]


def test_line_numbers_across_splits(spark, tmp_path):
    from knotwork.sources.text import numbered_lines

    p = write(tmp_path / "long.txt", "".join(f"line {k}\n" for k in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = numbered_lines(spark, p)
        assert got.where(F.concat(F.lit("line "), F.col("line").cast("string")) != F.col("text")).count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_shell(spark, a, tmp_path):
    from knotwork.sources.shell import Shell

    formats.write_matrix_market(a, str(tmp_path / "a"), 3, 3)
    shell = Shell(spark)
    said = shell.run(f'LOAD "{tmp_path}/a" "mtx" AS A; FORMAT A; CONVERT A "rows"; FORMAT A; MULTIPLY A A AS B; SAVE B "{tmp_path}/b"; PRINT B; EXIT; PRINT A')
    assert said == ["triples", "rows", "1 2 -1.5", "2 2 1.0", "3 2 3.0"]
    assert rows(formats.read_matrix_market(spark, str(tmp_path / "b"))) == [(1, 2, -1.5), (2, 2, 1.0), (3, 2, 3.0)]
