"""BPE encoding and decoding with a public vocabulary.

A word is an array of parts with the rank of each adjacent pair beside it. The array is scanned for the least
rank, the boundary there is deleted and the two neighbouring ranks are looked up again, until no pair has a
rank. Words of more than LONG parts keep the same parts and ranks, and find the least with a heap.

The vocabulary file (JSON: normaliser, splitting pattern, byte alphabet, merges, added tokens) is read on the
driver and broadcast; its size is checked against VOCABULARY_BYTES. Settled words are kept in two tables of
CACHED entries at most: when the young one is full it becomes the old one, and what is met again moves back. That
is only a matter of speed.

Defined cases: null and empty texts have no tokens, and decode to an empty text; strings of added tokens in a
text are those tokens; parts that the vocabulary lacks are left out; every row, repeated or not, is returned.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from knotwork.llm._shared import in_arrow, text_slices

VOCABULARY_BYTES = 64 << 20
LONG = 256
CACHED = 120_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """An encoder and decoder made from the text of a vocabulary file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec.get("decoder"):
            raise ValueError("this kind of vocabulary file is not known here")
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.alphabet = byte_alphabet()
        self.pairs = {}
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in model["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.young: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}

    def word(self, piece: str) -> list[int]:
        """Token ids of one piece of the splitting pattern."""
        shown = [self.alphabet[b] for b in piece.encode()]
        shown[-1] += self.end
        parts = [self.vocab[c] for c in shown if c in self.vocab]
        if len(parts) > LONG:
            return self._long(parts)
        pairs, none = self.pairs, (1 << 60, 0)
        ranks = [pairs.get(p, none) for p in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least is none:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [least[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = pairs.get((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = pairs.get((parts[k], parts[k + 1]), none)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        pairs, n = self.pairs, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks: list[tuple[int, int] | None] = [pairs.get(p) for p in zip(parts, parts[1:])] + [None]  # noqa: B905
        heap = [(r[0], k) for k, r in enumerate(ranks) if r]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if not ranks[k] or ranks[k][0] != rank:
                continue
            gone = after[k]
            parts[k], ranks[gone], parts[gone] = ranks[k][1], None, -1
            after[k] = after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for j in (before[k], k):
                if j >= 0:
                    ranks[j] = pairs.get((parts[j], parts[after[j]])) if after[j] >= 0 else None
                    if ranks[j]:
                        heapq.heappush(heap, (ranks[j][0], j))
        return [p for p in parts if p >= 0]

    def _settled(self, piece: str) -> tuple[str, str, int]:
        found = self.young.get(piece) or self.old.get(piece)
        if found is None:
            ids = self.word(piece)
            found = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found

    def _plain(self, part: str) -> list[str]:
        """The pieces of a text without added tokens. White space only parts them, whatever it is: the file's step
        that makes it one blank changes nothing and is left out."""
        plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
        return self.piece.findall(plain.lower())

    def _parts(self, text: str) -> list[str]:
        """Texts and added tokens in turn."""
        return self.marks.split(text) if self.marks and any(t in text for t in self.added) else [text]

    def pieces(self, text: str) -> Iterator[str | int]:
        """The pieces of a text in order; an added token is its id."""
        for k, part in enumerate(self._parts(text)):
            if k % 2:
                yield self.added[part]
            elif part:
                yield from self._plain(part)

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.pieces(text or "") for i in ([p] if isinstance(p, int) else self.word(p))]

    def decode(self, ids: list[int]) -> str:
        """As of a file without decoder: the tokens' own strings with a space between."""
        return " ".join([self.names[i] for i in ids])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the ids, and of the text that they decode to."""
        found: list[tuple[str, str, int]] = []
        for k, part in enumerate(self._parts(text or "")):
            if k % 2:
                found.append((str(self.added[part]), part, 1))
            elif part:
                get, settle = self.young.get, self._settled
                found += [get(p) or settle(p) for p in self._plain(part)]
        ids = " ".join([f[0] for f in found if f[2]])
        names = " ".join([f[1] for f in found if f[2]])
        return sum([f[2] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(names.encode()).hexdigest()


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if len(source) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return source


_coders: dict[int, WordBpe] = {}


def _coder(source) -> WordBpe:
    if source.id not in _coders:
        _coders.clear()
        _coders[source.id] = WordBpe(source.value)
    return _coders[source.id]


class _Source:
    """A broadcast with a name that workers can keep their encoder under."""

    def __init__(self, spark: SparkSession, text: str):
        self.broadcast, self.id = spark.sparkContext.broadcast(text), hash(text)

    @property
    def value(self) -> str:
        return self.broadcast.value


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text): the token ids themselves."""
    source = _Source(docs.sparkSession, read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(source)
        for part in text_slices(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array([coder.encode(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for every row of ``encoded`` (doc_id, ids); null ids are an empty text."""
    source = _Source(encoded.sparkSession, read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(source)
        for part in batches:
            yield pa.record_batch([part.column("doc_id"), pa.array([coder.decode(i or []) for i in part.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs`` (doc_id, text)."""
    source = _Source(docs.sparkSession, read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(source)
        for part in text_slices(batches):
            found = [coder.digests(t) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
