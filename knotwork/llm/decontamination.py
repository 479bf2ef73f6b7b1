"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks.

Each benchmark item of L words is held against the windows of L words of every document (the whole document,
where it is shorter). The measure: five-word shingles weighted by their number of occurrences, the sum of the
lesser weights over the sum of the greater ones, at least ``percent``.

Every document's windows get fingerprints for each length that items have: the signs of BITS sums over their shingles,
read from running sums. A fingerprint is cut into BLOCKS blocks. Two that differ in RADIUS bits at most differ in
RADIUS / BLOCKS bits at most in some block, so the items that agree so far in any block are all within the radius,
and about one unrelated window in a hundred is among them. What is within the radius is verified by the exact measure, over all
windows of that document. Windows of long items are taken every ``n // STRIDE`` shingles, and at a document's ends.

What the radius leaves out: two windows of unlike shingles at a similarity of 75 % differ in 22 of 128 bits on
average, at a stride's greatest offset in 28, standard deviation 4.7; RADIUS is three deviations beyond that. Fingerprints
say little where one shingle occurs often, since it rules all signs: where windows or items have repeated shingles,
the exact measure decides whatever their bits.

Defined cases: null, empty or short texts (under five words) match nothing, nor do items of under five words or
null; of windows as similar the first is reported; repeated rows and repeated items are each reported; columns
other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm._shared import in_arrow, text_bytes, text_slices
from knotwork.llm._text import U, mix, shingles, word_hashes

K, BITS = 5, 128
#: Hamming radius of the fingerprints, and blocks that a fingerprint is cut into (of 64 bits each).
RADIUS, BLOCKS = 43, 2
#: Windows of n shingles are taken every max(1, n // STRIDE) shingles: one is within n / 12 of any other.
STRIDE = 6
#: Items of one length that are held against a row of windows at a time.
ABREAST = 16
#: Words whose running sums are held at a time.
SUMMED = 1 << 14
#: Items that are broadcast at a time, by the bytes of their texts.
BLOCK_BYTES = 16 << 20


def signs(grams: np.ndarray) -> np.ndarray:
    """A row of BITS ones and minus ones for each shingle."""
    wide = np.stack([mix(grams ^ U(0xA0761D6478BD642F)), mix(grams ^ U(0xE7037ED1A0B428DB))], 1)
    return np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").view(np.int8) * np.int8(2) - np.int8(1)


def running_sums(rows: np.ndarray, kind: type) -> np.ndarray:
    """Sums of the first 0, 1, ... rows; inside strips side by side, then from strip to strip."""
    wide = 64
    strips = np.zeros((len(rows) // wide + 1, wide, rows.shape[1]), kind)
    strips.reshape(-1, rows.shape[1])[1 : len(rows) + 1] = rows
    for k in range(1, wide):
        strips[:, k] += strips[:, k - 1]
    strips[1:] += np.cumsum(strips[:-1, -1], axis=0, dtype=kind)[:, None]
    return strips.reshape(-1, rows.shape[1])[: len(rows) + 1]


def fingerprints(positive: np.ndarray) -> np.ndarray:
    """Fingerprints, as rows of two words, from the signs of sums."""
    return np.packbits(positive, axis=1, bitorder="little").view(np.uint64)


def in_some_block(windows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which windows, in rows by block, differ from the item in RADIUS // BLOCKS bits at most in some block."""
    first, second = (np.bitwise_count(windows[k] ^ item[k]) <= RADIUS // BLOCKS for k in range(BLOCKS))
    return first | second


def repeats(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each shingle the place of the last one before it, of its document, that is the same; -1 if none is."""
    by = np.lexsort((np.arange(len(grams)), grams, doc))
    same = (grams[by][1:] == grams[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    out = np.full(len(grams), -1)
    out[by[1:][same]] = by[:-1][same]
    return out


def lesser_weights(grams: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
    """Sums of the lesser weights of the item and of each window of ``size`` shingles.

    An occurrence counts in the windows that hold it, but not as many of its like before it as the item has.
    """
    own, times = np.unique(item, return_counts=True)
    key = np.minimum(np.searchsorted(own, grams), len(own) - 1)
    hits = np.flatnonzero(own[key] == grams)
    hits = hits[np.argsort(key[hits], kind="stable")]
    key = key[hits]
    before = np.arange(len(hits)) - times[key]
    known = before >= np.searchsorted(key, key)
    low = np.maximum(hits - size + 1, np.where(known, hits[before] + 1, 0)).clip(0)
    high = np.minimum(hits, len(grams) - size)
    some = low <= high
    steps = np.bincount(low[some], minlength=len(grams) + 1) - np.bincount(high[some] + 1, minlength=len(grams) + 1)
    return np.cumsum(steps)[: len(grams) - size + 1]


class Items:
    """Shingles, postings and summed signs of one block of items."""

    def __init__(self, ids: list[int], texts: list[str]):
        col = pa.array(texts, pa.string())
        hashes, rows, _, _ = word_hashes(*text_bytes(col))
        grams = shingles(hashes, K)
        self.ids, self.grams, self.words = [], [], []
        for i, a, b in zip(ids, rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= K:
                self.ids.append(i)
                self.grams.append(grams[a : b - K + 1])
                self.words.append(b - a)
        every = np.concatenate(self.grams) if self.grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.ids)), [len(g) for g in self.grams])
        by = np.lexsort((owner, every))
        new = np.r_[True, (every[by][1:] != every[by][:-1]) | (owner[by][1:] != owner[by][:-1])] if len(by) else np.zeros(0, bool)
        self.post, self.owner = every[by][new], owner[by][new]
        self.keys, self.first, self.count = np.unique(self.post, return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys >> U(44)] = True
        self.prints = fingerprints(np.stack([signs(g).sum(0, dtype=np.int64) > 0 for g in self.grams])) if self.ids else np.zeros((0, 2), np.uint64)
        self.sizes = np.array([len(g) for g in self.grams], np.int64)
        self.plain = np.array([len(np.unique(g)) == len(g) for g in self.grams], bool)

    def near(self, grams: np.ndarray, room: np.ndarray, rel: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(starts, items) of the windows within the radius of an item, and how many passed a block.

        room: shingles from each place to its document's end; rel: those before it. A shorter document is one window.
        """
        starts, found, passed = [], [], 0
        lengths = np.unique(self.sizes[self.plain])
        if not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        begins = np.flatnonzero((rel == 0) & (room > 0))
        ends = begins + room[begins]
        most = int(lengths[-1])
        kind = np.int16 if SUMMED + most < 32768 else np.int32
        for a in range(0, len(grams), SUMMED):
            own = grams[a : a + SUMMED + most]
            sums = running_sums(signs(own), kind)
            here = room[a : a + SUMMED]
            for n in lengths[lengths <= len(own)].tolist():
                step = max(1, n // STRIDE)
                up = min(len(here), len(own) - n + 1)
                at = np.arange(0, up, step)
                words = [fingerprints(sums[n : n + up : step] > sums[:up:step] if step >= 4 else (sums[n : n + up] > sums[:up])[::step])]
                if step > 1:  # the first and last windows of the documents
                    i, j = np.searchsorted(begins, (a, a + up))
                    k, m = np.searchsorted(ends, (a + n, a + n + up))
                    more = np.concatenate([begins[i:j][ends[i:j] - begins[i:j] >= n], ends[k:m][ends[k:m] - begins[k:m] > n] - n]) - a
                    at = np.concatenate([at, more])
                    words.append(fingerprints(sums[more + n] > sums[more]))
                windows = np.ascontiguousarray(np.concatenate(words).T)
                fits = here[at] >= n
                items = np.flatnonzero(self.plain & (self.sizes == n))
                for j in range(0, len(items), ABREAST):
                    k, some = np.nonzero(in_some_block(windows, self.prints[items[j : j + ABREAST]].T[:, :, None]) & fits)
                    k = items[j + k]
                    passed += len(some)
                    good = np.bitwise_count(windows[:, some] ^ self.prints[k].T).sum(0) <= RADIUS
                    starts.append(a + at[some[good]])
                    found.append(k[good])
            i, j = np.searchsorted(begins, (a, a + SUMMED))
            whole = begins[i:j][ends[i:j] - begins[i:j] < most] - a
            windows = fingerprints(sums[whole + here[whole]] > sums[whole])
            for j, w in enumerate(whole.tolist()):
                items = np.flatnonzero(self.plain & (self.sizes > here[w]) & (percent * self.sizes <= 100 * here[w]))
                items = items[in_some_block(self.prints[items].T, windows[j])]
                items = items[np.bitwise_count(self.prints[items] ^ windows[j]).sum(1) <= RADIUS]
                starts.append(np.full(len(items), a + w))
                found.append(items)
        return np.concatenate(starts).astype(np.int64), np.concatenate(found).astype(np.int64), passed

    def best(self, grams: np.ndarray, hits: np.ndarray, item: int, percent: int) -> tuple[float, int] | None:
        """The most similar window of a document for an item, by the exact measure: similarity and first word."""
        size = min(self.words[item] - K + 1, len(grams))
        last = len(grams) - size
        low, high = max(0, int(hits[0]) - size + 1), min(last, int(hits[-1]))
        start = np.arange(low, high + 1)
        shared = np.searchsorted(hits, start + size) - np.searchsorted(hits, start)
        total = size + len(self.grams[item])
        least = -(-percent * total // (100 + percent))
        start = start[shared >= least]
        if not len(start):
            return None
        a, b = int(start[0]), int(start[-1]) + size
        low = lesser_weights(grams[a:b], self.grams[item], size)[start - a]
        start, low = start[low >= least], low[low >= least]
        if not len(start):
            return None
        k = int(low.argmax())
        return int(low[k]) / (total - int(low[k])), int(start[k])

    def matches(self, data: np.ndarray, offs: np.ndarray, percent: int) -> list[tuple[int, int, float, int, int]]:
        """(row, item id, similarity, first word, words) of each item found in each row of a slice."""
        hashes, rows, _, _ = word_hashes(data, offs)
        if len(hashes) < K or not len(self.keys):
            return []
        grams = shingles(hashes, K)
        doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        place = np.arange(len(grams))
        room, rel = np.maximum(0, rows[1:][doc] - K + 1 - place), place - rows[:-1][doc]
        start, item, _ = self.near(grams, room, rel, percent)
        pairs = np.unique(np.stack([doc[start], item]), axis=1)

        # For the exact measure: where the documents hold an item's shingles.
        at = np.flatnonzero(self.sieve[grams >> U(44)] & (room > 0))
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        good = self.keys[key] == grams[at]
        at, key = at[good], key[good]
        n = self.count[key]
        where = np.repeat(self.first[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, at = self.owner[where], np.repeat(at, n)
        by = np.lexsort((at, item, doc[at]))
        item, at = item[by], at[by]
        cuts = np.flatnonzero(np.r_[True, (doc[at][1:] != doc[at][:-1]) | (item[1:] != item[:-1]), True]) if len(by) else np.zeros(1, int)
        near = np.zeros(0, np.int64) if not pairs.size else pairs[0] * len(self.ids) + pairs[1]
        held = doc[at[cuts[:-1]]] * len(self.ids) + item[cuts[:-1]]
        again = repeats(grams, np.where(room > 0, doc, -1 - place))
        checked = np.isin(held, near)
        found = []
        for j, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            d, k = int(doc[at[a]]), int(item[a])
            begin, end = int(rows[d]), int(rows[d + 1]) - K + 1
            size = min(self.words[k] - K + 1, end - begin)
            if not checked[j]:
                if (b - a) * (100 + percent) < percent * (size + len(self.grams[k])):
                    continue
                low, high = max(begin, int(at[a]) - size + 1), min(end, int(at[b - 1]) + size)
                if self.plain[k] and not (again[low:high] > np.arange(low, high) - size).any():
                    continue
            if best := self.best(grams[begin:end], at[a:b] - begin, k, percent):
                found.append((d, self.ids[k], best[0], best[1], min(self.words[k], end - begin + K - 1)))
        return found


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items in blocks of about BLOCK_BYTES, by a hash of the item."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // BLOCK_BYTES
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])


MATCH = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for each item found in each row of ``docs``."""
    out = None
    for items in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches):
                found = held.value.matches(*text_bytes(part.column("text")), percent)
                at = pa.array([x[0] for x in found], pa.int64())
                yield pa.record_batch([part.column("doc_id").take(at), *(pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64())))], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = in_arrow(docs.select("doc_id", "text"), run, MATCH)
        out = part if out is None else out.union(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found: one pass for each block of items, no shuffle."""
    for items in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches):
                clean = [True] * part.num_rows
                for x in held.value.matches(*text_bytes(part.column("text")), percent):
                    clean[x[0]] = False
                yield part.filter(pa.array(clean))

        docs = in_arrow(docs, run, docs.schema)
    return docs
