"""Suffix-array dedup by a depth-limited radix sort over bytes.

Suffixes are ordered only through their first WINDOW bytes, most significant digit first; suffixes that are
still together after the last digit are exactly the windows that occur more than once.

The first digit is an anchor: in every window the leftmost of the least GRAM-byte hashes. Equal windows have
equal anchors at equal places, so a window can only repeat where its anchor's bytes repeat, and one entry an
anchor (about one for 85 bytes) stands for all windows that it anchors. The anchors are dealt by their hash.
Where two occurrences of an anchor agree on all bytes of its windows, all of these repeat. Where they agree in
part, the bytes are fetched and the windows are sorted by the remaining digits. A pass over the cluster deals the
windows of a crowded anchor by their next digit: the leads (the anchor's places in a window) are halved, and all windows of a
half hold the same stretch around the anchor, which is the digit. A pass inside a task takes DIGIT bytes. Groups of one leave
after each pass, and what is crowded is dealt again, down to one lead, where the digit is the whole window.

Defined cases: a null text is empty; texts under WINDOW bytes lose nothing; a repeated row repeats all of its
windows, so it loses all that is WINDOW bytes or longer; matches never cross documents; null doc_ids take part;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm._shared import cut, in_arrow, text_bytes, text_slices, unused
from knotwork.llm._text import PLACE, U, mix, powers, prefix_sums, span_hash

WINDOW, GRAM, DIGIT = 200, 32, 40
ENTRY = np.dtype([("gram", "<u8"), ("span", "<u8"), ("row", "<i8"), ("pos", "<u4"), ("known", "u1")])
FULL, EDGE, WITNESS = 1, 2, 3
#: Entries that a task sorts at a time, and bytes of spans.
HELD, SPANS = 1 << 18, 2 << 20
#: Spans of a group that are sorted in one task; a larger group is dealt by the next digit first.
MEET = 4096


def anchors(data: np.ndarray, offs: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a slice in order: position, first and last window, and the hash of the anchor's bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, np.zeros(0, np.uint64)
    _, down = powers(len(data) + 1)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    least = (grams >> U(32) << U(32)) | np.arange(len(grams), dtype=np.uint64)
    width, want = 1, WINDOW - GRAM + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    last = np.repeat(offs[1:], np.diff(offs))[: len(least)] - WINDOW
    start = np.flatnonzero(np.arange(len(least)) <= last)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    at = (least[start] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[new], start[new], start[np.r_[new[1:] - 1, len(start) - 1]], grams[at[new]]


def _entries(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt() -> pa.RecordBatch:
            every = np.concatenate(held)
            every = every[np.lexsort((every["span"], every["gram"]))]
            first = np.r_[True, (every["gram"][1:] != every["gram"][:-1]) | (every["span"][1:] != every["span"][:-1])]
            several = np.r_[~first[1:], False] & first
            every["known"][several] = 1
            # What repeats inside the task is settled here: one entry of a kind travels, the others only carry the answer.
            bucket = np.where(first, every["gram"] % U(buckets), U(buckets) + every["row"].view(np.uint64) % U(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            every, bucket = every[by], bucket[by]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            return pa.record_batch([pa.array(bucket[cuts[:-1]]), pa.array([every[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["bucket", "entries"])

        for part in text_slices(batches):
            data, offs = text_bytes(part.column("text"))
            sums = prefix_sums(data)
            at, low, high, grams = anchors(data, offs, sums)
            if not len(at):
                continue
            entry = np.zeros(len(at), ENTRY)
            entry["gram"] = grams
            entry["span"] = mix(span_hash(sums, low, high + WINDOW) + (at - low).astype(np.uint64) * PLACE[0])
            doc = np.searchsorted(offs, at, "right") - 1
            entry["row"] = np.asarray(part.column("row"))[doc]
            entry["pos"] = at - offs[doc]
            held.append(entry)
            size += len(entry)
            if size >= HELD:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    return run


def _matched(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(x.as_py(), ENTRY) for x in table.column("entries")])
        if table.column("bucket")[0].as_py() >= buckets:
            flag = np.full(len(every), FULL, np.int8)
        else:
            every = every[np.lexsort((every["span"], every["gram"]))]
            new_gram = np.r_[True, every["gram"][1:] != every["gram"][:-1]]
            new_class = new_gram | np.r_[True, every["span"][1:] != every["span"][:-1]]
            gram, kind = np.cumsum(new_gram) - 1, np.cumsum(new_class) - 1
            full = (np.bincount(kind) > 1) | (np.bincount(kind, every["known"]) > 0)
            kinds = np.bincount(gram[new_class])
            single = np.bincount(gram[new_class], ~full)
            part = (kinds[gram] > 1) & (single[gram] > 0)
            flag = np.where(full[kind], np.where(part & new_class, WITNESS, FULL), np.where(part, EDGE, 0)).astype(np.int8)
            every, flag = every[flag > 0], flag[flag > 0]
        return pa.table({"row": every["row"], "pos": every["pos"].astype(np.int32), "gram": every["gram"].view(np.int64), "flag": flag})

    return run


def _placed(at: np.ndarray, grams: np.ndarray, begin: int, own: list[dict]) -> list[tuple[int, dict]]:
    """The marks of a row with their anchors' places; what is another row's, of the same key, is left out."""
    if not len(at):
        return []
    want = np.array([m["pos"] for m in own], np.int64) + begin
    where = np.minimum(np.searchsorted(at, want), len(at) - 1)
    good = (at[where] == want) & (grams[where].view(np.int64) == np.array([m["gram"] for m in own], np.int64))
    return [(int(where[k]), own[k]) for k in np.flatnonzero(good).tolist()]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of all windows of each marked anchor."""
    for part in text_slices(batches):
        data, offs = text_bytes(part.column("text"))
        at, low, high, grams = anchors(data, offs, prefix_sums(data))
        rows, marks = part.column("row").to_pylist(), part.column("marks").to_pylist()
        gram, row, pos, lead, flag, crowded, span = [], [], [], [], [], [], []
        raw = data.tobytes()
        for k, (r, own) in enumerate(zip(rows, marks, strict=True)):
            for j, m in _placed(at, grams, int(offs[k]), own):
                gram.append(m["gram"])
                row.append(r)
                pos.append(m["pos"])
                lead.append(int(at[j] - low[j]))
                flag.append(m["flag"])
                crowded.append(m["crowded"])
                span.append(raw[low[j] : high[j] + WINDOW])
        yield pa.record_batch([pa.array(gram, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(lead, pa.int32()), pa.array(flag, pa.int8()), pa.array(crowded, pa.bool_()), pa.array(span, pa.binary())], ["gram", "row", "pos", "lead", "flag", "crowded", "span"])


def _split(hot: DataFrame) -> DataFrame:
    """Spans (key, .., lo, hi) dealt by the next digit of their windows of leads lo to hi, in two halves.

    The digit of a half is the stretch that all its windows hold. Of a half without windows in a span, no row.
    """
    mid = F.expr("(lo + hi) div 2").cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))
    halved = hot.withColumn("half", F.explode(halves)).drop("lo", "hi").select("*", "half.lo", "half.hi").drop("half")
    halved = halved.where(f"lead >= lo AND lead - (octet_length(span) - {WINDOW}) <= hi")
    digit = F.substring("span", F.expr("lead - lo + 1"), F.expr(f"{WINDOW} - (hi - lo)"))
    again = F.when(F.col("lo") == F.col("hi"), F.xxhash64(F.lit(1), digit)).otherwise(F.lit(0).cast("long"))
    return halved.select(F.xxhash64("gram", "lo", "hi", digit).alias("key"), again.alias("proof"), "gram", "row", "pos", "lead", "flag", "span", "lo", "hi")


def radix_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which suffixes ``start`` share their first WINDOW bytes with another one of their ``group``."""
    sums = prefix_sums(data)
    left, group = np.arange(len(start)), np.unique(group, return_inverse=True)[1]
    for depth in range(0, WINDOW, DIGIT):
        keep = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        left, group = left[keep], group[keep]
        if not len(left):
            break
        digit = span_hash(sums, start[left] + depth, start[left] + depth + DIGIT)
        by = np.lexsort((digit, group))
        new = np.r_[True, (group[by][1:] != group[by][:-1]) | (digit[by][1:] != digit[by][:-1])]
        group = np.empty_like(group)
        group[by] = np.cumsum(new) - 1
    repeated = np.zeros(len(start), bool)
    if len(left):
        repeated[left[np.bincount(group)[group] > 1]] = True
    return repeated


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; pieces end where the key changes."""
    held: list[pa.RecordBatch] = []

    def settled(table: pa.Table) -> pa.RecordBatch:
        spans = table.column("span").combine_chunks()
        data, offs = text_bytes(spans.cast(pa.large_binary()))
        n = np.diff(offs) - WINDOW + 1
        owner = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lead = np.asarray(table.column("lead"))[owner] - inner
        key = np.unique(np.asarray(table.column("key")), return_inverse=True)[1][owner]
        repeated = np.zeros(len(owner), bool)
        own = np.flatnonzero((lead >= np.asarray(table.column("lo"))[owner]) & (lead <= np.asarray(table.column("hi"))[owner]))
        repeated[own] = radix_groups(data, (offs[owner] + inner)[own], (key * (WINDOW + 1) + lead)[own])
        cuts = np.r_[0, np.cumsum(n)]
        edge = np.flatnonzero(np.asarray(table.column("flag")) == EDGE)
        some = [k for k in edge.tolist() if repeated[cuts[k] : cuts[k + 1]].any()]
        bits = [np.packbits(repeated[cuts[k] : cuts[k + 1]]).tobytes() for k in some]
        which = pa.array(some, pa.int64())
        return pa.record_batch([*(table.column(c).take(which).combine_chunks() for c in ("row", "pos", "gram")), pa.array(bits, pa.binary())], ["row", "pos", "gram", "bits"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < SPANS:
            continue
        table = pa.Table.from_batches(held)
        key = np.asarray(table.column("key"))
        end = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        if end:
            yield settled(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield settled(pa.Table.from_batches(held))


def _gone(offs: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, grams: np.ndarray, k: int, own: list[dict]) -> np.ndarray:
    """Which bytes of row k are covered by its marked windows."""
    a, b = int(offs[k]), int(offs[k + 1])
    starts = np.zeros(b - a + 1, np.uint8)
    for j, m in _placed(at, grams, a, own):
        begin, n = int(low[j]) - a, int(high[j] - low[j]) + 1
        if m["inner"] is not None:
            starts[begin + np.array(m["inner"])] = 1
        else:
            starts[begin : begin + n] |= 1 if m["bits"] is None else np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=n)
    edge = np.zeros(b - a + 1, np.int32)
    edge += starts
    edge[WINDOW:] -= starts[:-WINDOW]
    return np.cumsum(edge)[: b - a] > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        data, offs = text_bytes(part.column("text"))
        at, low, high, grams = anchors(data, offs, prefix_sums(data))
        removed, spans, digest = [], [], []
        for k, own in enumerate(part.column("marks").to_pylist()):
            body = data[int(offs[k]) : int(offs[k + 1])]
            n = runs = 0
            if own:
                gone = _gone(offs, low, high, at, grams, k, own)
                n, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                body = body[~gone]
            removed.append(n)
            spans.append(runs)
            digest.append(hashlib.sha256(body.tobytes()).hexdigest())
        yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cleaned(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the repeated bytes taken out of their texts; null stays null. The last column holds the marks."""
        for part in text_slices(batches, place):
            data, offs = text_bytes(part.column(place))
            at, low, high, grams = anchors(data, offs, prefix_sums(data))
            texts = part.column(place).to_pylist()
            for k, own in enumerate(part.column(part.num_columns - 1).to_pylist()):
                if own:
                    body = data[int(offs[k]) : int(offs[k + 1])][~_gone(offs, low, high, at, grams, k, own)]
                    texts[k] = body.tobytes().decode("utf-8", "ignore")
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            kept[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(kept, part.schema.names[:-1])

    return run


def _marked(docs: DataFrame, meet: int) -> DataFrame:
    """The marks of the repeated windows of ``docs`` (doc_id, text) as (row, marks): an anchor's place, and which of its
    windows repeat, as bits or as a list; all of them if both are null. ``row`` is the key of doc_id and text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(65536, max(256, size // (64 << 20))))
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("row"))
    found = in_arrow(keyed, _entries(buckets), "bucket int, entries binary").groupBy("bucket").applyInArrow(_matched(buckets), "row long, pos int, gram long, flag byte")
    found = cut(found, "anchors")

    met = found.where(F.col("flag") >= EDGE)
    crowds = cut(met.groupBy("gram").count().where(F.col("count") > meet).select("gram", F.lit(True).alias("crowded")), "crowds")
    some = not crowds.isEmpty()
    met = met.join(crowds, "gram", "left") if some else met.withColumn("crowded", F.lit(None).cast("boolean"))
    own = met.groupBy("row").agg(F.collect_list(F.struct("pos", "gram", "flag", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("marks"))
    spans = in_arrow(keyed.join(own.hint("shuffle_hash"), "row").select("row", "text", "marks"), _spans, "gram long, row long, pos int, lead int, flag byte, crowded boolean, span binary")
    whole = F.lit(0).alias("lo"), F.lit(WINDOW - GRAM).alias("hi")
    columns = ["key", "gram", "row", "pos", "lead", "flag", "span", "lo", "hi"]
    none = F.lit(None).cast("binary").alias("bits"), F.lit(None).cast("array<int>").alias("inner")
    marks = found.where(F.col("flag") != EDGE).select("row", "pos", "gram", *none)
    spans = cut(spans, "spans") if some else spans
    parts = spans.where("NOT crowded").select(F.col("gram").alias("key"), "gram", "row", "pos", "lead", "flag", "span", *whole)
    hot = spans.where("crowded").select("gram", "row", "pos", "lead", "flag", "span", *whole) if some else None
    while hot is not None:
        dealt = cut(_split(hot), "digits")
        sizes = dealt.groupBy("key", "proof").agg(F.count("*").alias("n")).where("n > 1")
        dealt = cut(dealt.join(sizes, ["key", "proof"]), "groups")
        single = dealt.where((F.col("lo") == F.col("hi")) & (F.col("flag") == EDGE))
        marks = marks.union(single.groupBy("row", "pos", "gram").agg(F.collect_set(F.col("lead") - F.col("lo")).alias("inner")).select("row", "pos", "gram", none[0], "inner"))
        parts = parts.union(dealt.where((F.col("lo") < F.col("hi")) & (F.col("n") <= meet)).select(*columns))
        hot = dealt.where((F.col("lo") < F.col("hi")) & (F.col("n") > meet))
        hot = None if hot.isEmpty() else hot
    dealt = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    marks = marks.union(in_arrow(dealt, _sorted_windows, "row long, pos int, gram long, bits binary").select("row", "pos", "gram", "bits", none[1]))
    return marks.groupBy("row").agg(F.collect_list(F.struct("pos", "gram", "bits", "inner")).alias("marks"))


def repeated_bytes(docs: DataFrame, meet: int = MEET) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    joined = docs.withColumn("row", F.xxhash64("doc_id", "text")).join(_marked(docs, meet), "row", "left").select("doc_id", "text", "marks")
    return in_arrow(joined, _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, meet: int = MEET) -> DataFrame:
    """The rows of ``docs``, all columns, with the repeated bytes taken out of ``text``.

    Where a cut leaves part of a character's bytes, the rest of that character goes too. Columns may have any names.
    """
    row, marks = unused(docs.columns, "row"), unused(docs.columns, "marks")
    found = _marked(docs.select("doc_id", "text"), meet).withColumnsRenamed({"row": row, "marks": marks})
    joined = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(found, row, "left").select(*(F.col(f"`{c}`") for c in docs.columns), marks)
    return in_arrow(joined, _cleaned([c.lower() for c in docs.columns].index("text")), docs.schema)
