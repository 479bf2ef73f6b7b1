"""Readers and writers of graph and matrix files. Files count from 1, tables keep the ids that the files have
unless a reader says that it moves them to 0. Text is read in splits; only headers come to the driver. A word that
is no number becomes NULL (filters of a caller may be pushed below the reader's own, so a strict cast would meet
header lines)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.matrix import expand_symmetry
from knotwork.sources.text import numbered_lines, one_file


@dataclass
class Header:
    rows: int
    cols: int
    entries: int
    field: str = "real"
    symmetry: str = "general"


def _parts(text: str = "text") -> Column:
    return F.split(F.trim(text), r"\s+")


# Matrix Market.


def matrix_market_header(spark: SparkSession, path: str) -> Header:
    head = spark.read.text(path).where("value LIKE '\\%\\%MatrixMarket%'").first()
    words = head[0].lower().split() if head else ["", "matrix", "coordinate", "real", "general"]
    if words[2] != "coordinate":
        raise ValueError("only coordinate files are known here")
    size = numbered_lines(spark, path).where("text NOT LIKE '\\%%' AND trim(text) <> ''").orderBy("line").first()
    rows, cols, n = (int(x) for x in size["text"].split()[:3])
    return Header(rows, cols, n, words[3], words[4])


def read_matrix_market(spark: SparkSession, path: str, expand: bool = False, zero_based: bool = False) -> DataFrame:
    """(row, col, val); a complex file has (row, col, re, im). ``expand`` mirrors symmetric storage."""
    h = matrix_market_header(spark, path)
    lines = numbered_lines(spark, path).where("text NOT LIKE '\\%%' AND trim(text) <> ''")
    first = lines.agg(F.min("line")).first()[0]
    p = lines.where(F.col("line") > first).select(_parts().alias("p"))
    shift = 1 if zero_based else 0
    place = [(F.col("p")[0].try_cast("long") - shift).alias("row"), (F.col("p")[1].try_cast("long") - shift).alias("col")]
    if h.field == "complex":
        m = p.select(*place, F.col("p")[2].try_cast("double").alias("re"), F.col("p")[3].try_cast("double").alias("im"))
        if expand and h.symmetry != "general":
            sign = -1 if h.symmetry == "skew-symmetric" else 1
            conj = -1 if h.symmetry == "hermitian" else sign
            m = m.unionByName(m.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("re") * sign).alias("re"), (F.col("im") * conj).alias("im")))
        return m
    m = p.select(*place, (F.lit(1.0) if h.field == "pattern" else F.col("p")[2].try_cast("double")).alias("val"))
    return expand_symmetry(m, h.symmetry) if expand and h.symmetry != "general" else m


def write_matrix_market(a: DataFrame, path: str, rows: int, cols: int, field: str = "real") -> None:
    """Entries in order of column and row, from 1 on as they are."""
    n = a.count()
    spark = a.sparkSession
    head = spark.createDataFrame([(0, 0, f"%%MatrixMarket matrix coordinate {field} general"), (1, 0, f"{rows} {cols} {n}")], "c long, r long, text string")
    value = [] if field == "pattern" else [F.col("val").cast("string")]
    body = a.select((F.col("col") + 2).alias("c"), F.col("row").alias("r"), F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), *value).alias("text"))
    one_file(head.unionByName(body), ["c", "r"], path)


def read_harwell_boeing(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val) of an assembled real or pattern file of column pointers, row numbers and values."""
    lines = numbered_lines(spark, path)
    head = [r["text"] for r in lines.where("line < 5").orderBy("line").collect()]
    counts = [int(x) for x in head[1].split()]
    kind, (rows, cols, n) = head[2][:3].strip().upper(), (int(x) for x in head[2][3:].split()[:3])
    body = 5 if len(counts) > 4 and counts[4] > 0 else 4
    ends = [body + counts[1], body + counts[1] + counts[2]]
    words = lines.where(F.col("line") >= body).select("line", F.posexplode(_parts()).alias("k", "word")).where("word <> ''")
    from knotwork.plans.ranking import positions

    def section(low: int, high: int | None) -> DataFrame:
        own = words.where((F.col("line") >= low) & (F.lit(True) if high is None else F.col("line") < high))
        return positions(own, ["line", "k"]).select("pos", F.regexp_replace("word", "[dD]", "e").alias("word"))

    pointers = section(body, ends[0]).select(F.col("pos").alias("c"), F.col("word").try_cast("long").alias("p"))
    following = pointers.select((F.col("c") - 1).alias("c"), F.col("p").alias("q"))
    spans = pointers.join(following, "c").where("q > p").select((F.col("c") + 1).alias("col"), F.explode(F.sequence(F.col("p") - 1, F.col("q") - 2)).alias("pos"))
    m = spans.join(section(ends[0], ends[1]).select("pos", F.col("word").try_cast("long").alias("row")), "pos")
    if kind[0] == "P":
        m = m.select("row", "col", F.lit(1.0).alias("val"))
    else:
        m = m.join(section(ends[1], None).select("pos", F.col("word").try_cast("double").alias("val")), "pos").select("row", "col", "val")
    return expand_symmetry(m, {"S": "symmetric", "Z": "skew-symmetric"}[kind[1]]) if kind[1] in "SZ" else m


# Plain triples, vectors and edges.


def read_triples(spark: SparkSession, path: str, values: bool = True, transpose: bool = False, zero_based: bool = True) -> tuple[Header, DataFrame]:
    """Comments of %, a line ``rows cols entries``, then ``row col [val]`` from 1 on."""
    lines = numbered_lines(spark, path).where("text NOT LIKE '\\%%' AND trim(text) <> ''")
    first = lines.orderBy("line").first()
    rows, cols, n = (int(x) for x in first["text"].split()[:3])
    shift = 1 if zero_based else 0
    p = lines.where(F.col("line") > first["line"]).select(_parts().alias("p"))
    m = p.select((F.col("p")[0].try_cast("long") - shift).alias("row"), (F.col("p")[1].try_cast("long") - shift).alias("col"), (F.col("p")[2].try_cast("double") if values else F.lit(1.0)).alias("val"))
    if transpose:
        return Header(cols, rows, n), m.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    return Header(rows, cols, n), m


def write_triples(a: DataFrame, path: str, rows: int, cols: int, transpose: bool = False) -> None:
    """From 0 in the table, from 1 in the file, in order of column and row."""
    m = a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val") if transpose else a
    head = a.sparkSession.createDataFrame([(-1, -1, f"{cols if transpose else rows} {rows if transpose else cols} {a.count()}")], "c long, r long, text string")
    body = m.select(F.col("col").alias("c"), F.col("row").alias("r"), F.concat_ws("\t", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("val").cast("string")).alias("text"))
    one_file(head.unionByName(body), ["c", "r"], path)


def read_vector(spark: SparkSession, path: str, dense: bool = False) -> DataFrame:
    """A line ``length entries``, then ``idx val`` from 1 on; (idx, val) from 0 on, dense with zeros."""
    lines = numbered_lines(spark, path).where("trim(text) <> ''")
    first = lines.orderBy("line").first()
    v = lines.where(F.col("line") > first["line"]).select(_parts().alias("p")).select((F.col("p")[0].try_cast("long") - 1).alias("idx"), F.col("p")[1].try_cast("double").alias("val"))
    if not dense:
        return v
    return spark.range(int(first["text"].split()[0])).select(F.col("id").alias("idx")).join(v, "idx", "left").select("idx", F.coalesce("val", F.lit(0.0)).alias("val"))


def write_vector(v: DataFrame, path: str, length: int) -> None:
    head = v.sparkSession.createDataFrame([(-1, f"{length} {v.count()}")], "o long, text string")
    one_file(head.unionByName(v.select(F.col("idx").alias("o"), F.concat_ws("\t", (F.col("idx") + 1).cast("string"), F.col("val").cast("string")).alias("text"))), ["o"], path)


def read_snap(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) of pairs, lines of # left out."""
    p = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) <> ''").select(_parts("value").alias("p"))
    return p.select(F.col("p")[0].try_cast("long").alias("src"), F.col("p")[1].try_cast("long").alias("dst"), F.lit(1).alias("w")).distinct()


def write_edges(e: DataFrame, path: str, weight: bool = False, shift: int = 0, sep: str = " ") -> None:
    cols = [(F.col("src") + shift).cast("string"), (F.col("dst") + shift).cast("string")] + ([F.col("w").cast("string")] if weight else [])
    e.select(F.concat_ws(sep, *cols).alias("text")).write.mode("overwrite").text(path)


def write_tuple_graph(e: DataFrame, path: str) -> None:
    """``v0 v1 1`` from 1 on, a file a partition."""
    e.select(F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.lit("1")).alias("text")).write.mode("overwrite").text(path)


def write_counted_edges(e: DataFrame, path: str) -> None:
    """The number of edges, then ``i j`` lines."""
    head = e.sparkSession.createDataFrame([(-1, -1, str(e.count()))], "a long, b long, text string")
    one_file(head.unionByName(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("text"))), ["a", "b"], path)


def write_parts(parts: DataFrame, path: str) -> None:
    """``vertex part``, both from 1 on."""
    one_file(parts.select("v", F.concat_ws(" ", (F.col("v") + 1).cast("string"), (F.col("part") + 1).cast("string")).alias("text")), ["v"], path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.text(path).where("trim(value) <> ''").select(_parts("value").alias("p"))
    return p.select((F.col("p")[0].try_cast("long") - 1).alias("v"), (F.col("p")[1].try_cast("int") - 1).alias("part"))


def append_history(row: DataFrame, path: str) -> None:
    """One more row of measures of a pass."""
    row.write.mode("append").parquet(path)


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) from 1 on: line i holds the neighbours of i, with weights if the header says so."""
    lines = numbered_lines(spark, path).where("text NOT LIKE '\\%%'")
    head = lines.orderBy("line").first()
    flags = (head["text"].split() + ["0", "0", "0"])[2].zfill(3) if len(head["text"].split()) > 2 else "000"
    nodes = int(head["text"].split()[3]) if len(head["text"].split()) > 3 else int(flags[1])
    skip = (nodes if flags[1] == "1" else 0) + int(flags[0])
    from knotwork.plans.ranking import positions

    rows = positions(lines.where(F.col("line") > head["line"]), ["line"], "src", 1)
    words = rows.select("src", F.filter(_parts(), lambda x: x != "").alias("p")).select("src", F.slice("p", skip + 1, 1 << 30).alias("p"))
    if flags[2] == "1":
        pairs = words.select("src", F.posexplode("p").alias("k", "x")).groupBy("src", F.floor(F.col("k") / 2).alias("g")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("x"))).alias("d"), F.max(F.when(F.col("k") % 2 == 1, F.col("x"))).alias("w"))
        return pairs.select("src", F.col("d").try_cast("long").alias("dst"), F.col("w").cast("double").alias("w"))
    return words.select("src", F.explode("p").alias("d")).select("src", F.col("d").try_cast("long").alias("dst"), F.lit(1.0).alias("w"))


def write_metis(e: DataFrame, path: str, n: int) -> None:
    """Vertices 1 to n, undirected edges both ways, weights left out."""
    lists = e.where("src <> dst").groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_set("dst")), lambda x: x.cast("string")), " ").alias("text"))
    m = e.where("src < dst").select("src", "dst").distinct().count()
    spark = e.sparkSession
    head = spark.createDataFrame([(0, f"{n} {m}")], "o long, text string")
    body = spark.range(1, n + 1).select(F.col("id").alias("src")).join(lists, "src", "left").select(F.col("src").alias("o"), F.coalesce("text", F.lit("")).alias("text"))
    one_file(head.unionByName(body), ["o"], path)


# Typed edges.


def read_typed_edges(spark: SparkSession, path: str) -> DataFrame:
    """``row col follower count [date time]`` after a header line: (src, dst, follower, count, latest) from 0 on."""
    lines = numbered_lines(spark, path).where("text NOT LIKE '\\%%' AND trim(text) <> ''")
    first = lines.agg(F.min("line")).first()[0]
    p = lines.where(F.col("line") > first).select(_parts().alias("p"))
    when = F.to_timestamp(F.concat_ws(" ", F.try_element_at("p", F.lit(5)), F.try_element_at("p", F.lit(6))))
    count = F.col("p")[3].try_cast("short")
    return p.select((F.col("p")[0].try_cast("long") - 1).alias("src"), (F.col("p")[1].try_cast("long") - 1).alias("dst"), (F.col("p")[2].try_cast("int") != 0).alias("follower"), count.alias("count"), F.when(count > 0, when).alias("latest"))


def write_typed_edges(e: DataFrame, path: str) -> None:
    e.select("src", "dst", F.col("follower").cast("int").alias("follower"), "count", F.coalesce(F.unix_timestamp("latest"), F.lit(0)).alias("latest")).write.mode("overwrite").option("sep", "\t").csv(path)


# Binary files: each holds fixed-width records and is read by its own task.


def _records(spark: SparkSession, path: str, dtype: np.dtype, schema: str, skip: int = 0) -> DataFrame:
    names = list(dtype.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = np.frombuffer(content.as_py(), dtype, offset=skip)
                for at in range(0, len(rows), 1 << 20):
                    part = rows[at : at + (1 << 20)]
                    yield pa.record_batch([pa.array(np.ascontiguousarray(part[n])) for n in names], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _write_records(rows: DataFrame, dtype: np.dtype, path: str, head: bytes = b"") -> None:
    """One file of a head and fixed-width records. Tasks pack them; the driver passes on one chunk at a time."""
    names = list(dtype.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.empty(batch.num_rows, dtype)
            for n in names:
                packed[n] = batch.column(n).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array([packed[at : at + (1 << 15)].tobytes() for at in range(0, len(packed), 1 << 15)], pa.binary())], ["chunk"])

    context = rows.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(head))
        for row in rows.select(*names).mapInArrow(pack, "chunk binary").toLocalIterator():
            out.write(bytearray(row["chunk"]))
    finally:
        out.close()


def write_edge_dump(e: DataFrame, path: str, bits: int = 64) -> None:
    """Raw pairs (src, dst)."""
    kind = "<i8" if bits == 64 else "<i4"
    _write_records(e.where("src IS NOT NULL AND dst IS NOT NULL"), np.dtype([("src", kind), ("dst", kind)]), path)


def read_edge_dump(spark: SparkSession, path: str, bits: int = 64) -> DataFrame:
    """(src, dst) of raw pairs; negative ids are no edges."""
    kind, name = ("<i8", "long") if bits == 64 else ("<i4", "int")
    raw = _records(spark, path, np.dtype([("src", kind), ("dst", kind)]), f"src {name}, dst {name}")
    e = raw.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return e.where("src >= 0 AND dst >= 0")


def parse_binary_header(content: bytes) -> dict[str, int]:
    """Magic HKDT, then version, object size, format, rows, columns and entries as 64-bit numbers."""
    if content[:4] != b"HKDT":
        raise ValueError("not a file of this kind")
    return dict(zip(("version", "object_size", "format", "rows", "cols", "entries"), struct.unpack("<6Q", content[4:52]), strict=True))


def read_binary_triples(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val) of a file with a binary header and records of int64, int64, double."""
    return _records(spark, path, np.dtype([("row", "<i8"), ("col", "<i8"), ("val", "<f8")]), "row long, col long, val double", skip=52)


def write_binary_triples(a: DataFrame, path: str, rows: int, cols: int) -> None:
    """A binary header, then records of int64, int64, double."""
    head = b"HKDT" + struct.pack("<6Q", 1, 24, 0, rows, cols, a.count())
    _write_records(a.select("row", "col", F.col("val").cast("double").alias("val")), np.dtype([("row", "<i8"), ("col", "<i8"), ("val", "<f8")]), path, head)


_TYPED = np.dtype([("src", "<i4"), ("dst", "<i4"), ("follower", "?"), ("count", "<i2"), ("time", "<i8")])


def write_typed_edge_records(e: DataFrame, path: str) -> None:
    """(src, dst, follower, count, latest) from 0 on as packed records; never active is time 0."""
    time = F.coalesce(F.unix_timestamp("latest"), F.lit(0)).alias("time")
    _write_records(e.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "follower", "count", time), _TYPED, path)


def read_typed_edge_records(spark: SparkSession, path: str) -> DataFrame:
    """int32 from, int32 to (from 1), bool follow, int16 retweets, int64 time, packed."""
    e = _records(spark, path, _TYPED, "src int, dst int, follower boolean, count short, time long")
    return e.select((F.col("src").cast("long") - 1).alias("src"), (F.col("dst").cast("long") - 1).alias("dst"), "follower", "count", F.when(F.col("count") > 0, F.timestamp_seconds("time")).alias("latest"))


# Formats of other programs.


def write_pajek(e: DataFrame, path: str, n: int, directed: bool = False) -> None:
    """Vertices 1 to n by number, then edges or arcs with weights."""
    spark = e.sparkSession
    head = spark.createDataFrame([(0, 0, 0, f"*Vertices {n}"), (2, 0, 0, "*Arcs" if directed else "*Edges")], "s int, a long, b long, text string")
    names = spark.range(1, n + 1).select(F.lit(1).alias("s"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string('%d "%d"', "id", "id").alias("text"))
    own = e if directed else e.where("src <= dst")
    body = own.select(F.lit(3).alias("s"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("w").cast("string")).alias("text"))
    one_file(head.unionByName(names).unionByName(body), ["s", "a", "b"], path)


def read_pajek(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w); edges come both ways, arcs as they are."""
    lines = numbered_lines(spark, path)
    starts = {r["text"].split()[0].lower(): r["line"] for r in lines.where("text LIKE '*%'").collect()}
    out = None
    for name, both in (("*edges", True), ("*arcs", False)):
        if name in starts:
            end = min((x for x in starts.values() if x > starts[name]), default=1 << 60)
            p = lines.where((F.col("line") > starts[name]) & (F.col("line") < end) & (F.trim("text") != "")).select(_parts().alias("p"))
            own = p.select(F.col("p")[0].try_cast("long").alias("src"), F.col("p")[1].try_cast("long").alias("dst"), F.coalesce(F.try_element_at("p", F.lit(3)).try_cast("double"), F.lit(1.0)).alias("w"))
            if both:
                own = own.unionByName(own.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no edges and no arcs")
    return out


def read_pajek_points(spark: SparkSession, path: str) -> DataFrame:
    """(v, x, y, z) of the vertices that have coordinates."""
    lines = numbered_lines(spark, path)
    marks = sorted((r["line"], r["text"].split()[0].lower()) for r in lines.where("text LIKE '*%'").collect())
    begin = next(x for x, t in marks if t == "*vertices")
    end = min((x for x, _ in marks if x > begin), default=1 << 60)
    p = lines.where((F.col("line") > begin) & (F.col("line") < end)).select(F.split(F.trim(F.regexp_replace("text", '"[^"]*"', "_")), r"\s+").alias("p"))
    return p.select(F.col("p")[0].try_cast("long").alias("v"), *[F.try_element_at("p", F.lit(k + 3)).try_cast("double").alias(c) for k, c in enumerate("xyz")]).where("x IS NOT NULL")


def write_dl_matrix(e: DataFrame, path: str, n: int, most: int = 3000) -> None:
    """The full matrix, vertices 1 to n; refused beyond ``most`` vertices."""
    if n > most:
        raise ValueError(f"{n} vertices are beyond {most}")
    spark = e.sparkSession
    space = spark.range(n * n).select((F.floor(F.col("id") / n) + 1).alias("src"), (F.col("id") % n + 1).alias("dst"))
    full = space.join(e.select("src", "dst", "w"), ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(0)).cast("string").alias("w"))
    rows = full.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", "w"))), lambda x: x["w"]), " ").alias("text"))
    head = spark.createDataFrame([(-1, f"DL N={n}"), (0, "format = fullmatrix"), (0, "data:")], "o long, text string")
    one_file(head.unionByName(rows.select(F.col("src").alias("o"), "text")).withColumn("t", F.col("text") == "data:"), ["o", "t"], path)


def write_dl_edges(e: DataFrame, path: str, n: int) -> None:
    head = e.sparkSession.createDataFrame([(-3, 0, f"DL N={n}"), (-2, 0, "format = edgelist1"), (-1, 0, "data:")], "a long, b long, text string")
    one_file(head.unionByName(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("w").cast("string")).alias("text"))), ["a", "b"], path)


def write_cytoscape(e: DataFrame, path: str) -> None:
    e.select("src", "dst", "w").write.mode("overwrite").option("sep", ";").csv(path)


def write_hypergraph(a: DataFrame, path: str, rows: int, cols: int) -> None:
    """A partitioner's hypergraph: cells are rows, nets are columns, each net's cells on a line."""
    nets = a.groupBy("col").agg(F.array_join(F.transform(F.sort_array(F.collect_set("row")), lambda x: x.cast("string")), " ").alias("text"))
    spark = a.sparkSession
    head = spark.createDataFrame([(-1, f"0 {rows} {cols} {a.count()}")], "o long, text string")
    body = spark.range(cols).select(F.col("id").alias("col")).join(nets, "col", "left").select(F.col("col").alias("o"), F.coalesce("text", F.lit("")).alias("text"))
    one_file(head.unionByName(body), ["o"], path)


def read_mat(spark: SparkSession, path: str, name: str = "A") -> DataFrame:
    """(row, col, val) of the sparse matrix Problem.A of a .mat file, read on the driver; needs SciPy."""
    import scipy.io

    held = scipy.io.loadmat(path)
    m = (held["Problem"][name][0, 0] if "Problem" in held else held[name]).tocoo()
    return spark.createDataFrame(pa.table({"row": m.row.astype("int64") + 1, "col": m.col.astype("int64") + 1, "val": m.data.astype("float64")}))


READERS = {"mtx": read_matrix_market, "hb": read_harwell_boeing, "snap": read_snap, "metis": read_metis, "pajek": read_pajek, "mat": read_mat}


def load(spark: SparkSession, path: str, kind: str = "mtx", **options) -> DataFrame:
    return READERS[kind](spark, path, **options)


def circle_points(v: DataFrame) -> DataFrame:
    """(v, x, y): the vertices in order of id around a circle, which is what a circular drawing needs."""
    from knotwork.plans.ranking import positions

    n = v.count()
    turn = 2 * 3.141592653589793 * F.col("pos") / max(1, n)
    return positions(v.select("v"), ["v"]).select("v", F.cos(turn).alias("x"), F.sin(turn).alias("y"))
