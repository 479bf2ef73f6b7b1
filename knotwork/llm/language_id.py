"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three letters, words framed by a
blank), most frequent first. A document's own list is held to each profile: every n-gram adds the distance of
its two ranks, or the greatest distance where the profile lacks it. The language with the least sum is
predicted. Profiles count every n-gram of every document that may be learned from.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the language first in
order; n-grams of equal count are ranked by their letters; documents with null lang are not learned from; an
empty training set leaves ``und`` for all; null doc_ids count by the remainder of an empty text, which is 0; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from knotwork.llm._shared import in_arrow, text_slices

#: Length of a profile and of a document's list.
RANKS = 400
#: n-grams of a language that a task keeps apart before it hands them on.
COUNTED = 1 << 19
PLANE = 0x110000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    if not _letters:
        out = np.zeros(PLANE, np.int64)
        for c in range(0x80):
            out[c] = ord(chr(c).lower()) if chr(c).isalpha() else 0
        _letters.append(out)
        _letters.append(np.arange(PLANE) < 0x80)
    return _letters[0]


def folded(points: np.ndarray) -> np.ndarray:
    """Lower-case letters of code points, 0 elsewhere; code points beyond ASCII are looked up once."""
    out, known = letters(), _letters[1]
    new = np.unique(points[~known[points]])
    for c in new.tolist():
        low = chr(c).lower()
        out[c] = (ord(low) if len(low) == 1 else c) if chr(c).isalpha() else 0
        known[c] = True
    return out[points]


def gram_codes(points: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of a text, each letter 21 bits; a frame of blanks, and no gram without a letter."""
    c = folded(points)
    keep = c > 0
    keep[1:] |= c[:-1] > 0  # one blank after a word
    c = np.concatenate([[0], c[keep], [0]])
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    # A blank inside ties two words together: only the frames at a word's ends stay.
    return np.concatenate([c[c > 0], two[two > 0] | (1 << 62), three[c[1:-1] > 0]])


def ranked(points: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The ``most`` most frequent n-grams of a text in order of rank."""
    codes = np.sort(gram_codes(points))
    if not len(codes):
        return codes
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    count = np.diff(np.r_[first, len(codes)])
    if len(first) > most:
        least = np.partition(count, len(count) - most)[len(count) - most]
        keep = count >= least
        first, count = first[keep], count[keep]
    by = np.argsort(-count, kind="stable")[:most]
    return codes[first[by]]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, times), summed over a task's slices as far as they fit."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def dealt() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            times = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(times)], ["lang", "gram", "times"])

    for part in text_slices(batches):
        by: dict[str, list[str]] = {}
        for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            codes, times = np.unique(gram_codes(_points("\n".join(texts))), return_counts=True)
            held.setdefault(lang, []).append((codes, times))
            size += len(codes)
        if size > COUNTED:
            yield from dealt()
            held, size = {}, 0
    yield from dealt()


def learn_profiles(docs: DataFrame, ranks: int = RANKS) -> dict[str, np.ndarray]:
    """The profile of each language of ``docs`` (text, lang): at most ``ranks`` n-grams a language reach the driver."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    total = in_arrow(rows, _counts, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    foremost = Window.partitionBy("lang").orderBy(F.desc("times"), "gram")
    top = total.withColumn("k", F.row_number().over(foremost)).where(F.col("k") <= ranks).select("lang", "gram", "times")
    out: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, times in top.collect():
        out.setdefault(lang, []).append((-times, gram))
    return {lang: np.array([g for _, g in sorted(out[lang])], np.int64) for lang in sorted(out)}


class Profiles:
    """Learned profiles, ready to be held to documents."""

    def __init__(self, profiles: dict[str, np.ndarray], ranks: int = RANKS):
        self.langs, self.ranks, self.sorted = list(profiles), ranks, []
        for lang in self.langs:
            by = np.argsort(profiles[lang])
            self.sorted.append((profiles[lang][by], by))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(_points(text or ""), self.ranks)
        if not len(own) or not self.langs:
            return "und", 0.0
        apart = []
        for grams, rank in self.sorted:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            apart.append(int(np.where(grams[at] == own, np.abs(rank[at] - np.arange(len(own))), self.ranks).sum()))
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - apart[best] / (self.ranks * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Every row of ``docs`` with lang_pred and score added in front of it as (lang_pred, score, *columns)."""
    held = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))
    schema = "lang_pred string, score double"
    names = [n for n in docs.columns if n not in ("lang_pred", "score")]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = [held.value.predict(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), *part.columns], ["lang_pred", "score", *names])

    return in_arrow(docs, run, StructType([*StructType.fromDDL(schema).fields, *docs.schema.fields]))


def held_out(of: int, rest: int):
    """Whether crc32 of the doc_id's text leaves ``rest`` when divided by ``of``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == rest


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang)."""
    profiles = learn_profiles(docs.where(~held_out(5, 0)))
    return identify(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
