"""Exact top-k search by inner product over a bit-sliced index.

A block of vectors is kept as bitmaps: for each attribute the bits of its quantised values, one bitmap a bit.
A query's inner products with all rows of the block are sums of shifted bitmaps (complemented for negative
weights), made by bitwise full adders. The rows to look at are selected from the most significant slice
downward: the k-th largest sum, then all rows within the width that quantisation may hide. These boundary rows
are resolved by their exact integer products.

Blocks are formed where their rows are read, and are written once, with their bitmaps, to the shared folder: no
vector is shuffled. Queries go out in chunks of a bounded size, one broadcast and one pass over the blocks each; of each
block and query only the k best rows are left, and these meet in a ranking by query.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, as query or as
candidate; vectors meet only vectors of their own length; null ids take no part; a repeated row is a candidate
by itself, but never one of a query of its own id; a repeated query row is answered for itself, under its one id;
ties go to the smaller id; other columns are ignored. Scores are 64-bit integers: exact while the products of any two
vectors' scaled components, added up by size, stay below 2**63; beyond, they wrap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm._shared import cut, in_arrow

#: Bits kept of an attribute; rows and components of a block at most (64 rows at least); components of a chunk of queries.
SLICES, ROWS, VALUES, CHUNK = 7, 32768, 1 << 21, 1 << 20
#: Size of a scaled component from which on a block is kept without bitmaps.
HUGE = 1 << 40
INDEX = "dims int, bits int, shift int, wide boolean, ids binary, rows binary, slices binary"


class BitSlicedIndex:
    """Quantised attributes of a block of integer vectors, as bitmaps."""

    def __init__(self, values: np.ndarray, slices: int = SLICES, stored: tuple[int, int, bytes] | None = None):
        self.values, n, dims = values, len(values), values.shape[1]
        self.words = -(-n // 64)
        self.all = self._bitmap(np.ones(n, bool))
        if stored is None and max(int(values.max()), -int(values.min())) >= HUGE:  # all rows are looked at
            self.bits, self.shift, maps = 0, 0, np.zeros(0, np.uint64)
        elif stored is None:
            low = values.min(0)
            span = values.max(0) - low
            self.shift = max(0, int(span.max()).bit_length() - slices)
            self.bits = max(1, int(span.max() >> self.shift).bit_length())
            coarse = (values - low) >> self.shift
            maps = np.stack([self._bitmap((coarse[:, d] >> b) & 1 == 1) for d in range(dims) for b in range(self.bits)])
        else:
            self.bits, self.shift, raw = stored
            maps = np.frombuffer(raw, np.uint64) if raw else np.zeros(0, np.uint64)
        self.slices = maps.reshape(dims, self.bits, self.words)
        self.absent = self.all & ~self.slices

    def _bitmap(self, rows: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, bool)
        padded[: len(rows)] = rows
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def sums(self, weights: list[int]) -> list[np.ndarray]:
        """Bitmaps of the bits, least first, of sum |w| * (value or its complement) over the attributes."""
        columns: list[list[np.ndarray]] = []
        for w, there, gone in zip(weights, self.slices, self.absent, strict=True):
            size = abs(w)
            for b, one in enumerate(there if w > 0 else gone):
                rest, at = size, b
                while rest:
                    if rest & 1:
                        while len(columns) <= at:
                            columns.append([])
                        columns[at].append(one)
                    rest >>= 1
                    at += 1
        out, at = [], 0
        while at < len(columns):
            stack = columns[at]
            while len(stack) > 1:
                if at + 1 == len(columns):
                    columns.append([])
                a, b = stack.pop(), stack.pop()
                half = a ^ b
                if stack:
                    c = stack.pop()
                    stack.insert(0, half ^ c)
                    half &= c
                    a = a & b
                    a |= half
                    columns[at + 1].append(a)
                else:
                    stack.append(half)
                    columns[at + 1].append(a & b)
            out.append(stack[0] if stack else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def kth(self, sums: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, from the most significant slice downward; the least if there are fewer rows."""
        sure, tied, value = 0, self.all, 0
        for b in range(len(sums) - 1, -1, -1):
            ones = tied & sums[b]
            n = int(np.bitwise_count(ones).sum())
            if sure + n >= k:
                tied, value = ones, value | (1 << b)
            else:
                sure += n
                tied = tied & ~sums[b]
        return value

    def at_least(self, sums: list[np.ndarray], least: int) -> np.ndarray:
        """Rows whose sum is ``least`` or more."""
        above, tied = np.zeros(self.words, np.uint64), self.all
        for b in range(len(sums) - 1, -1, -1):
            if least >> b & 1:
                tied = tied & sums[b]
            else:
                above |= tied & sums[b]
                tied = tied & ~sums[b]
        chosen = above | tied
        return np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little")[: len(self.values)])

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows among which are the k largest inner products with ``query``."""
        if len(self.values) <= k or not self.bits:
            return np.arange(len(self.values))
        weights = query.tolist()
        sums = self.sums(weights)
        if not sums:
            return np.arange(len(self.values))
        hidden = sum(map(abs, weights)) * ((1 << self.shift) - 1) >> self.shift
        return self.at_least(sums, max(0, self.kth(sums, k) - hidden - 1))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as blocks: ids, components, and the bitmaps of the components' bits."""
    held: dict[int, list] = {}

    def block(dims: int) -> pa.RecordBatch:
        ids, values = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
        index = BitSlicedIndex(values)
        wide = int(values.max()) >= 1 << 15 or int(values.min()) < -(1 << 15)
        columns = (dims, index.bits, index.shift, wide, ids.tobytes(), values.astype(np.int64 if wide else np.int16).tobytes(), index.slices.tobytes())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([x], t) for x, t in zip(columns, kinds, strict=True)], ["dims", "bits", "shift", "wide", "ids", "rows", "slices"])

    for batch in batches:
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        ends, ids = np.r_[0, np.cumsum(sizes)], np.asarray(batch.column("vec_id"))
        for dims in np.unique(sizes).tolist():
            most = max(64, min(ROWS, VALUES // dims))
            own = np.flatnonzero(sizes == dims)
            while len(own):
                kept = held.setdefault(dims, [])
                some = own[: most - sum(len(x) for x, _ in kept)]
                kept.append((ids[some], flat[ends[some][:, None] + np.arange(dims)]))
                own = own[len(some) :]
                if sum(len(x) for x, _ in kept) == most:
                    yield block(dims)
    for dims in list(held):
        yield block(dims)


def _answered(k: int, queries):
    def best(index: BitSlicedIndex, ids: np.ndarray, own: int, query: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray]:
        rows = index.candidates(query, k + copies)
        rows = rows[ids[rows] != own]
        scores = index.values[rows] @ query
        by = np.lexsort((ids[rows], -scores))[:k]
        return ids[rows][by], scores[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dims"] not in queries.value:
                    continue
                ids = np.frombuffer(row["ids"], np.int64)
                values = np.frombuffer(row["rows"], np.int64 if row["wide"] else np.int16).reshape(len(ids), row["dims"]).astype(np.int64)
                index = BitSlicedIndex(values, stored=(row["bits"], row["shift"], row["slices"]))
                copies = int(np.unique(ids, return_counts=True)[1].max())
                asked, vectors = queries.value[row["dims"]]
                found = [best(index, ids, own, query, copies) for own, query in zip(asked.tolist(), vectors, strict=True)]
                yield pa.record_batch([pa.array(np.repeat(asked, [len(x) for x, _ in found])), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([y for _, y in found]))], ["query_id", "vec_id", "score"])

    return run


def _chunks(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Query rows by their number of components, ids and vectors, in chunks of about CHUNK components."""
    numbered = queries.withColumn("at", F.xxhash64(F.monotonically_increasing_id()))
    size = queries.agg(F.sum(F.col("dims").cast("long"))).first()[0] or 0
    n = -(-size // CHUNK)
    numbered = cut(numbered.select("dims", "vec_id", "v", F.pmod("at", F.lit(n)).alias("chunk")), "queries") if n > 1 else numbered.withColumn("chunk", F.lit(0))
    for chunk in range(n):
        rows = numbered.where(F.col("chunk") == chunk).select("dims", "vec_id", "v").toArrow()
        dims, ids = np.asarray(rows.column("dims")), np.asarray(rows.column("vec_id"))
        out = {}
        for d in np.unique(dims).tolist():
            own = np.flatnonzero(dims == d)
            out[d] = ids[own], np.asarray(rows.column("v").take(pa.array(own)).combine_chunks().flatten()).reshape(len(own), d)
        yield out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) with vec_id divisible by
    ``every``, the ``k`` other rows of largest integer inner product of floor(scale * component)."""
    spark = vectors.sparkSession
    x = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    x = x.where(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    x = x.select(F.col("vec_id").cast("long"), F.transform("e", lambda c: F.floor(c * scale).cast("long")).alias("v"), F.size("e").alias("dims"))
    # A block costs a query about the same work whatever its size, so tasks that read less than a block are joined.
    whole = x.select("vec_id", "v").coalesce(max(1, -(-x.count() // ROWS)))
    index, found = cut(in_arrow(whole, _indexed, INDEX), "index"), None
    for chunk in _chunks(x.where(F.col("vec_id") % every == 0)):
        part = cut(in_arrow(index, _answered(k, spark.sparkContext.broadcast(chunk)), "query_id long, vec_id long, score long"), "best")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
