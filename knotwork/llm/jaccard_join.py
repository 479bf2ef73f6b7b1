"""N-gram Jaccard join by a token-group matrix.

Documents are sets of distinct five-word shingles. Documents with equal sets are one node. Nodes are parted into
groups of similar ones: those of about one size whose rare shingles lead most often to the same node. The matrix
of tokens and groups is stored twice. For rare shingles it has a row for each token and group that holds it, with
the least and greatest size there; a query asks the groups it meets in these rows, so that a shingle of many nodes
costs its nodes times its few groups. For all shingles, folded to 65,536 columns, it has the union of each piece of
a group; a fold can only raise a bound. A query goes by its columns to the unions of the groups it asks, and only
pieces whose union holds as many of them as any link needs are opened, with texts, and compared exactly. Each pair
of nodes that can link meets once, so all links are found and counted; a piece gives its classes and counts only.

Which pairs can link at all follows from one global order of the shingles, rare ones first: two sets with
Jaccard similarity t or more share one of their first n - ceil(t * n) + 1 shingles. The order is a hint
(common shingles, as counted over all documents, go last); whatever it is, no pair is lost. A node is known by 64
bits, proven by 64 others: if two sets ever had one number, all would be numbered anew.

Defined cases: a null or blank text has no shingles and is its own class; texts of one to four words are
one shingle; null doc_ids take part and get the class of their set; repeated rows are each returned;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm._shared import components, cut, cut_by, in_arrow, text_bytes, text_slices, unused
from knotwork.llm._text import U, mix, shingle_rows

#: Shingles whose place in the order follows their count: 3 MB of broadcast at most, at any input size.
ORDERED = 1 << 18
#: Tokens that a task counts together.
COUNTED = 1 << 20
#: Members of a group and queries that meet in one piece of work, and about how many shingles of either.
MEMBERS, QUERIES, SHINGLES = 128, 512, 1 << 18
#: Roles in a piece beside 0: a member that compares itself with the others that do, and a query from elsewhere.
ASKS, QUERY = 1, 2
#: Bytes of a union of all columns, and unions that meet in one piece of work.
BITMAP, UNIONS = 8192, 1024
ENTRY = np.dtype([("low", "<u4"), ("mid", "u1"), ("node", "<u8"), ("n", "<u4"), ("pos", "<u2")])

MARKS = ["doc_id", "n", "node", "proof", "row", "twin", "token", "times"]
FINGERPRINT = "doc_id long, n int, node long, proof long, row long, twin long, token long, times long"


def _node(grams: np.ndarray, seed: int, salt: int = 0x5851F42D4C957F2D) -> int:
    """One number for a set of shingles."""
    return int(mix(mix(grams ^ (U(salt) + U(seed))).sum(dtype=np.uint64, keepdims=True) + np.full(1, len(grams), np.uint64)).view(np.int64)[0])


def _fingerprints(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and rows (token, times) for tokens that several different sets of this task hold."""
        held, size, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            tokens, times = tokens[times > 1].view(np.int64), times[times > 1].astype(np.int64)
            none = pa.nulls(len(tokens), pa.int64())
            return pa.record_batch([none, none.cast(pa.int32()), none, none, none, none, pa.array(tokens), pa.array(times)], MARKS)

        for part in text_slices(batches):
            rows = shingle_rows(*text_bytes(part.column("text")))
            nodes = [_node(g, seed) if len(g) else None for g in rows]
            proofs = [_node(g, seed, 0x2545F4914F6CDD1D) if len(g) else None for g in rows]
            none = pa.nulls(len(rows), pa.int64())
            yield pa.record_batch([part.column("doc_id"), pa.array([len(g) for g in rows], pa.int32()), pa.array(nodes, pa.int64()), pa.array(proofs, pa.int64()), part.column("row"), part.column("twin"), none, none], MARKS)
            for node, grams in zip(nodes, rows, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(grams)
                    size += len(grams)
            if size >= COUNTED:
                yield counted()
                held, size, seen = [], 0, set()
        if held:
            yield counted()

    return run


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (n * percent + 99) // 100 + 1


def _prefixes(order, buckets: int, percent: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = order.value
        seen: set[int] = set()
        held, size = [], 0

        def dealt() -> pa.RecordBatch:
            every = np.concatenate(held)
            where = every["bucket"]
            by = np.argsort(where, kind="stable")
            every, where = every[by], where[by]
            cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
            out = np.empty(len(every), ENTRY)
            for name in ENTRY.names:
                out[name] = every[name]
            return pa.record_batch([pa.array(where[cuts[:-1]].astype(np.int32)), pa.array([out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["bucket", "entries"])

        wide = np.dtype([("bucket", "<u4"), *ENTRY.descr])
        for part in text_slices(batches):
            for grams in shingle_rows(*text_bytes(part.column("text"))):
                if not len(grams) or (node := _node(grams, seed)) in seen:
                    continue
                seen.add(node)
                first, known = grams, np.zeros(0, np.int64)
                most = prefix_length(len(grams), percent)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                    common = hot[at] == grams
                    if common.any():
                        first, known = grams[~common], at[common]
                        known = known[np.argsort(rank[known], kind="stable")][: max(0, most - len(first))]
                first = first[:most]
                entry = np.empty(len(first) + len(known), wide)
                own, listed = entry[: len(first)], entry[len(first) :]
                own["bucket"] = (first >> U(40)) % U(buckets)
                own["low"] = first & U(0xFFFFFFFF)
                own["mid"] = (first >> U(32)) & U(0xFF)
                # A common shingle goes by its place in the list: several sets are known to hold it, so its entries
                # need not meet, and are dealt by set.
                listed["bucket"] = buckets + node % buckets
                listed["low"] = known
                listed["mid"] = 0
                entry["node"] = np.uint64(node & 0xFFFFFFFFFFFFFFFF)
                entry["n"] = len(grams)
                entry["pos"] = np.minimum(np.arange(len(entry)), 0xFFFF)
                held.append(entry)
                size += len(entry)
            if size >= COUNTED // 2:
                yield dealt()
                held, size, seen = [], 0, set()
        if held:
            yield dealt()

    return run


def _runs(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """The entries of tokens that at least two nodes of a bucket share, and those of listed tokens."""
        bucket = table.column("bucket")[0].as_py()
        every = np.concatenate([np.frombuffer(x.as_py(), ENTRY) for x in table.column("entries")])
        token = every["low"].astype(np.int64) | (every["mid"].astype(np.int64) << 32)
        by = np.lexsort((every["node"], token))
        every, token = every[by], token[by]
        new = np.r_[True, (token[1:] != token[:-1]) | (every["node"][1:] != every["node"][:-1])]
        every, token = every[new], token[new]
        if bucket >= buckets:
            token = -1 - token
        else:
            same = token[1:] == token[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            every, token = every[keep], token[keep] + (bucket << 40)
        return pa.table({"token": token, "node": every["node"].astype(np.uint64).view(np.int64), "n": every["n"].astype(np.int32), "pos": every["pos"].astype(np.int32)})

    return run


class Members:
    """Members (node, copies, shingles) of a piece of a group, side by side."""

    def __init__(self, rows: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, np.array([len(g) for g in rows])
        tokens, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), self.sizes)
        by = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[by], owner[by]

    def linked(self, grams: np.ndarray) -> np.ndarray:
        """Places of all members that link with a set of shingles."""
        left, right = np.searchsorted(self.tokens, grams, "left"), np.searchsorted(self.tokens, grams, "right")
        n = right - left
        at = np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= self.percent * (len(grams) + self.sizes - both))


def _pieces(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], column: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted partitions, piece by piece: (key, [(column's value, node, role, n or copies)])."""
    key, rows = None, []
    for batch in batches:
        for part in text_slices(iter([batch]), column):
            values = shingle_rows(*text_bytes(part.column(column))) if column == "text" else part.column(column).to_pylist()
            named = zip(*(part.column(c).to_pylist() for c in keys), strict=True)
            for now, *row in zip(named, values, *(part.column(c).to_pylist() for c in ("node", "role", "times")), strict=True):
                if now != key:
                    if rows:
                        yield key, rows
                    key, rows = now, []
                rows.append(tuple(row))
    if rows:
        yield key, rows


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the matrix columns of all their shingles, two bytes each."""
    for part in text_slices(batches):
        rows = shingle_rows(*text_bytes(part.column("text")))
        columns = [np.sort((g >> U(48)).astype("<u2")).tobytes() for g in rows]
        yield pa.record_batch([*part.columns, pa.array(columns, pa.binary())], [*part.schema.names, "columns"])


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of the matrix for each piece of a group: the columns that its members hold, as a list or as bits."""
    for (label, sub), rows in _pieces(batches, ("label", "sub"), "columns"):
        every = np.unique(np.concatenate([np.frombuffer(x, "<u2") for x, *_ in rows]))
        held = every if 2 * len(every) < BITMAP else _bits(every)
        yield pa.record_batch([pa.array([label], pa.int64()), pa.array([sub], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["label", "sub", "columns"])


def _bits(columns: np.ndarray) -> np.ndarray:
    bits = np.zeros(8 * BITMAP, np.uint8)
    bits[columns] = 1
    return np.packbits(bits)


def _qualifying(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, label, sub) where the union holds as many of a query's columns as any link needs."""
        for (label, _, _), rows in _pieces(batches, ("label", "chunk", "block"), "columns"):
            unions = [r for r in rows if not r[2]]
            subs = np.array([r[3] for r in unions], np.int32)
            matrix = np.stack([np.frombuffer(r[0], np.uint8) if len(r[0]) == BITMAP else _bits(np.frombuffer(r[0], "<u2")) for r in unions]) if unions else np.zeros((0, BITMAP), np.uint8)
            nodes, found = [], []
            for held, node, role, least in rows:
                if not role:
                    continue
                columns = np.frombuffer(held, "<u2")
                shared = ((matrix[:, columns >> 3] >> (7 - (columns & 7)).astype(np.uint8)) & 1).sum(1, dtype=np.int64)
                good = subs[(subs >= least) & (100 * shared >= percent * len(columns))]
                nodes += [node] * len(good)
                found += good.tolist()
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([label] * len(nodes), pa.int64()), pa.array(found, pa.int32())], ["node", "label", "sub"])

    return run


def _compared(rows: list[tuple], first: bool, percent: int) -> tuple[list[int], list[int], list[int]]:
    """Nodes of a piece that link, each with the least of its class within the piece and its links there, by rows."""
    members = [r for r in rows if r[2] < QUERY]
    queries = [(len(members) + k, r) for k, r in enumerate(r for r in rows if r[2] == QUERY)]
    asks = np.array([r[2] == ASKS for r in members])
    if first:
        queries = [(k, members[k]) for k in np.flatnonzero(asks).tolist()] + queries
    if not members or not queries:
        return [], [], []
    every = members + [r for k, r in queries if k >= len(members)]
    nodes, copies = np.array([r[1] for r in every]), np.array([r[3] for r in every])
    links, parent, held = np.zeros(len(every), np.int64), list(range(len(every))), Members([r[0] for r in members], percent)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, row in queries:
        good = held.linked(row[0])
        if k < len(members):
            good = good[(good > k) & asks[good]]
        if not len(good):
            continue
        links[k] += copies[good].sum()
        links[good] += copies[k]
        for j in good.tolist():
            a, b = root(k), root(j)
            if a != b:
                parent[max(a, b, key=nodes.__getitem__)] = min(a, b, key=nodes.__getitem__)
    some = np.flatnonzero(links)
    return nodes[some].tolist(), [int(nodes[root(k)]) for k in some.tolist()], links[some].tolist()


def _opened(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list[int], ...] = [], [], []
        for (_, _, chunk), rows in _pieces(batches, ("label", "sub", "chunk"), "text"):
            for out, more in zip(found, _compared(rows, chunk == 0, percent), strict=True):
                out += more
            if len(found[0]) > 10_000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in found], ["node", "root", "links"])
                found = [], [], []
        yield pa.record_batch([pa.array(x, pa.int64()) for x in found], ["node", "root", "links"])

    return run


def _parts(df: DataFrame, keys: list[str], rows: int, name: str) -> DataFrame:
    """How many parts the rows (.., n) of each key are dealt to: ``rows`` rows or SHINGLES shingles each, about."""
    heavy = F.greatest(F.count("*") / rows, F.sum(F.col("n").cast("long")) / SHINGLES)
    return df.groupBy(*keys).agg(F.ceil(heavy).cast("int").alias(name))


def _dealt(work: DataFrame, *keys: str) -> DataFrame:
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(parts, *keys).sortWithinPartitions(*keys, "role")


def open_groups(asked: DataFrame, grouped: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(node, root, links) for nodes that link: ``asked`` (node, label) are compared with the groups they ask.

    grouped: (node, n, label), each node's own group; texts: (node, text, columns, copies). A pair of different
    groups is to be asked from one side. Groups are split into pieces and each piece's union of columns is stored;
    a query goes, by its columns alone, to all unions of a group it asks, and with its text to the pieces whose
    union leaves it room for a link. ``links`` are rows in a piece, by copies; ``root`` is of the same class.
    """
    own = asked.join(grouped, ["node", "label"], "left_semi").select("node", F.lit(True).alias("asks"))
    members = grouped.join(asked.select("label").distinct(), "label", "left_semi")
    subs = _parts(members, ["label"], MEMBERS, "subs")
    members = members.join(subs, "label").join(own, "node", "left")
    members = cut(members.select("node", "n", "label", "subs", F.pmod(F.xxhash64("node"), "subs").cast("int").alias("sub"), F.coalesce("asks", F.lit(False)).alias("asks")), "members")

    # A member of the group itself asks the pieces after its own one: in that one all its members are at hand.
    sizes = grouped.select("node", "n")
    apart = members.select("node", "label", (F.col("sub") + 1).alias("least"))
    asking = asked.join(members.select("label", "subs").distinct(), "label").join(sizes, "node").join(apart, ["node", "label"], "left").withColumn("least", F.coalesce("least", F.lit(0))).where("least < subs")
    asking = cut(asking.select("node", "n", "label", "subs", "least"), "asking")
    sketches = texts.select("node", "columns")
    queried = members.join(asking.select("label").distinct(), "label", "left_semi").join(sketches, "node")
    rows = queried.select("label", "sub", "columns", "node", F.lit(0).alias("role"), F.lit(0).alias("times"))
    unions = cut(in_arrow(_dealt(rows, "label", "sub"), _unions, "label long, sub int, columns binary"), "unions")

    chunks = _parts(asking, ["label"], QUERIES, "chunks")
    blocks = F.explode(F.sequence(F.expr(f"least div {UNIONS}"), F.expr(f"(subs - 1) div {UNIONS}"))).alias("block")
    q = asking.join(chunks, "label").select("label", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), blocks, "node", F.lit(QUERY).alias("role"), F.col("least").alias("times"))
    q = q.join(sketches, "node").select("label", "chunk", "block", "columns", "node", "role", "times")
    u = unions.join(chunks, "label").select("label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.expr(f"sub div {UNIONS}").alias("block"), "columns", F.lit(0).cast("long").alias("node"), F.lit(0).alias("role"), F.col("sub").alias("times"))
    qualified = cut(in_arrow(_dealt(q.union(u), "label", "chunk", "block"), _qualifying(percent), "node long, label long, sub int"), "qualified")

    q = qualified.join(sizes, "node")
    chunks = _parts(q, ["label", "sub"], QUERIES, "chunks")
    q = q.join(chunks, ["label", "sub"]).select("label", "sub", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), "node", F.lit(QUERY).alias("role"))
    inner = members.where("asks").groupBy("label", "sub").agg(F.count("*").alias("own"))
    m = members.join(chunks, ["label", "sub"], "left").join(inner, ["label", "sub"], "left").where("chunks is not null or own > 1")
    m = m.select("label", "sub", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"), "node", F.when(F.col("asks"), ASKS).otherwise(0).alias("role"))
    work = q.union(m).join(texts.select("node", "text", F.col("copies").alias("times")), "node")
    return cut(in_arrow(_dealt(work, "label", "sub", "chunk"), _opened(percent), "node long, root long, links long"), "links")


def _fits(percent: int, n, pos, low, high, ahead):
    """Whether a set of n shingles with a shared one at pos can link with one of low to high with it at ``ahead`` or later.

    The needed overlap is percent/(100+percent) of both sizes, and from a shared shingle on, the first one that both
    hold, at most n - pos are left.
    """
    smallest = F.greatest(low, F.ceil(n * percent / 100))
    return (100 * high >= percent * n) & (percent * low <= 100 * n) & (F.least(n - pos, high - ahead) * (100 + percent) >= percent * (n + smallest))


def _keys(row: str = "row", twin: str = "twin") -> list[Column]:
    """128 bits that stand for doc_id and text of a row."""
    return [F.xxhash64("doc_id", "text").alias(row), F.xxhash64(F.lit(1), "text", "doc_id").alias(twin)]


def _classified(docs: DataFrame, percent: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows with their sets' nodes (doc_id, n, node, copies, row, twin), and (node, root, links) of the nodes that link.

    row and twin are the rows' keys, as ``_keys`` makes them.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", *_keys())
    marks = cut(in_arrow(rows, _fingerprints(seed), FINGERPRINT), "sets")
    sets = marks.where("times is null").select("doc_id", "n", "node", "proof", "row", "twin")
    known = cut(sets.where("node is not null").groupBy("node").agg(F.min(F.struct("row", "twin")).alias("at"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min("proof").alias("proof"), F.max("proof").alias("other")), "nodes")
    if not known.where("proof <> other").isEmpty():  # two sets under one number: all are numbered anew
        return _classified(docs, percent, seed + 1)

    shared = marks.where("times is not null").groupBy("token").agg(F.sum("times").alias("times")).where("times > 3")
    top = shared.orderBy(F.desc("times"), "token").limit(ORDERED).toArrow()
    tokens = np.asarray(top.column("token")).view(np.uint64)
    by = np.argsort(tokens)
    order = spark.sparkContext.broadcast((tokens[by], (len(tokens) - by).astype(np.int32)))
    total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    buckets = int(min(65536, max(512, total // 1_000_000)))
    entries = in_arrow(rows.select("text"), _prefixes(order, buckets, percent, seed), "bucket int, entries binary")
    runs = cut(entries.groupBy("bucket").applyInArrow(_runs(buckets), "token long, node long, n int, pos int"), "runs")

    # Groups: nodes whose rare shingles lead to the same node most often, and are of about the same size.
    leads = runs.groupBy("token").agg(F.min("node").alias("lead"), F.count("*").alias("holders")).where("holders > 1").drop("holders")
    met = cut(runs.join(leads, "token"), "met")
    votes = met.groupBy("node", "n", "lead").agg(F.count("*").alias("votes"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))) if percent < 100 else F.col("n")
    grouped = votes.groupBy("node", "n").agg(F.max_by("lead", F.struct("votes", "lead")).alias("lead")).select("node", "n", F.xxhash64("lead", band.cast("long")).alias("label"))
    grouped = cut(grouped, "grouped")
    named = cut(met.drop("lead").join(grouped.drop("n"), "node"), "named")

    # The rows of the token-group matrix for rare shingles, with the bounds of each entry's members.
    held = named.groupBy("token", F.col("label").alias("group")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("ahead"), F.count("*").alias("holders"))
    other = (F.col("label") > F.col("group")) | ((F.col("label") == F.col("group")) & (F.col("holders") > 1))
    can = _fits(percent, *(F.col(c) for c in ("n", "pos", "low", "high", "ahead")))
    asked = cut(named.join(held, "token").where(other & can).select("node", F.col("group").alias("label")).distinct(), "asked")

    wanted = grouped.join(asked.select("label").distinct(), "label", "left_semi").select("node").union(asked.select("node")).distinct()
    wanted = known.select("node", "at.*", "copies").join(wanted, "node")
    texts = rows.select("row", "twin", "text").join(wanted.hint("shuffle_hash"), ["row", "twin"]).select("node", "copies", "text").dropDuplicates(["node"])
    texts = cut_by(in_arrow(texts, _sketched, "node long, copies long, text string, columns binary"), "texts", "node")
    return sets.drop("proof").join(known.select("node", "copies"), "node", "left"), open_groups(asked, grouped, texts, percent)


def near_duplicate_classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text); see the module's text.

    n_links is the number of other rows that the row links with, copies counted.
    """
    sets, links = _classified(docs, percent)
    labels = components(links, "node", "root")
    counts = links.groupBy("node").agg(F.sum("links").alias("others"))
    classes = sets.withColumnRenamed("n", "n_shingles").join(labels, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))
    return classes.join(least, "label", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), n_links.cast("long").alias("n_links"))


def one_of_each_class(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, that lead their class: that of the least doc_id, nulls last, once.

    Rows without words all stay. Columns may have any names beside doc_id and text.
    """
    sets, links = _classified(docs, percent)
    labels = components(links, "node", "root")
    classes = sets.where("node is not null").join(labels, "node", "left")
    lead = classes.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "twin")).alias("lead"))
    row, twin = unused(docs.columns, "row"), unused(docs.columns, "twin")
    kept = lead.select(F.col("lead.row").alias(row), F.col("lead.twin").alias(twin))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = docs.select("*", *_keys(row, twin))
    first = own.where(~blank).join(kept.hint("shuffle_hash"), [row, twin], "left_semi").dropDuplicates([row, twin])
    return first.unionByName(own.where(blank)).select(*(F.col(f"`{c}`") for c in docs.columns))
