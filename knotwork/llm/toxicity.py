"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lowers letters, takes accents off, replaces look-alike letters of other scripts and digits and signs
that stand for letters, leaves out marks put between letters, and turns all else into blanks. Entries are whole
words, or beginnings that many words share. They are learned from labelled documents with their weights: the
log odds of a toxic document given the entry. Phrases in which an entry is harmless are exceptions: an entry
inside one does not count. The sum of weights and the same divided by the text's length give the score.

Defined cases: null and empty texts score as texts without an entry; without labels of both classes nothing is
toxic (score 0); repeated rows are each scored; null doc_ids count by the remainder of an empty text; of
several labels of a document the greatest counts.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm._labels import Sample, labelled_sample
from knotwork.llm._shared import in_arrow, text_slices
from knotwork.llm.language_id import held_out

#: Evidence (G squared) and log odds that an entry needs, the lengths of beginnings, and most entries.
EVIDENCE, ODDS, BEGINNINGS, ENTRIES = 20.0, 1.5, (4, 5, 6), 5000
#: The share of toxic documents from which a text is called toxic.
TOXIC_FROM = 0.3

# What digits, signs and look-alike letters stand for; l and i share one form, as 1 is read as either.
STANDS_FOR = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i",
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "д": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ӏ": "i", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n", "и": "u", "з": "e",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "σ": "o", "ɡ": "g", "ɑ": "a", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
LEFT_OUT = frozenset(".-_*'`~\u2019\u00ad\u200b\u200c\u200d\u2060\ufeff")
#: Phrases in which the word is no insult, beside those that are learned.
HARMLESS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "pond scum")


class _Folding(dict):
    """What each code point becomes, worked out when first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if c in LEFT_OUT or unicodedata.category(c) in ("Mn", "Me", "Cf"):
            out = ""
        else:
            base = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(STANDS_FOR.get(x, x if x.isalnum() else " ") for x in STANDS_FOR.get(base, base)) or " "
        self[point] = out
        return out


FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Folded text with a blank at both ends."""
    return f" {(text or '').translate(FOLDING)} "


def _evidence(t: int, c: int, toxic: int, clean: int) -> float:
    """G squared of an entry in t of the toxic and c of the clean documents."""
    n, share = t + c, toxic / (toxic + clean)
    parts = ((t, n * share), (c, n * (1 - share)))
    return 2 * sum(x * math.log(x / e) for x, e in parts if x)


class Lexicon:
    """Weighted entries, exceptions, and the curve from sums to a share of toxic documents."""

    def __init__(self, entries: dict[str, float], exceptions: list[str], curve: list[float] | None):
        self.entries, self.exceptions, self.curve = entries, exceptions, curve
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for e, w in self.entries.items():
                self._automaton.add_word(e, (len(e), w))
            for e in self.exceptions:
                self._automaton.add_word(e, (len(e), None))
            self._automaton.make_automaton()
        return self._automaton

    def sums(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of the entries outside exceptions, and the number of words."""
        folded = fold(text)
        words = len(folded.split())
        if not self.entries:
            return 0.0, words
        found, safe = [], []
        for end, (n, w) in self.automaton.iter(folded):
            (safe if w is None else found).append((end - n, end, w))
        # A word and a beginning of it are one finding: the heavier counts.
        best: dict[int, tuple[float, int]] = {}
        for a, b, w in found:
            if not any(s <= a and b <= e for s, e, _ in safe):
                best[a] = max(best.get(a, (0.0, 0)), (w, b))
        return sum(w for w, _ in best.values()), words

    def features(self, text: str | None) -> list[float]:
        total, words = self.sums(text)
        return [1.0, math.log1p(total), math.log1p(100 * total / max(1, words))]

    def score(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        z = sum(a * b for a, b in zip(self.curve, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fitted_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> list[float]:
    """Weighted logistic regression by Newton's steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def _harmless(sample: Sample, entries: dict[str, float], toxic: int, clean: int) -> set[str]:
    """Two words, one of them an entry, that are as much of clean documents as an entry is of toxic ones."""
    held: dict[int, Counter] = {0: Counter(), 1: Counter()}
    begins = tuple(e for e in entries if not e.endswith(" "))
    for text, y in zip(sample.texts, sample.labels, strict=True):
        words = fold(text).split()
        hit = [f" {w} " in entries or f" {w}".startswith(begins) for w in words]
        held[y].update({f" {words[k]} {words[k + 1]} " for k in range(len(words) - 1) if hit[k] or hit[k + 1]})
    found = set()
    for phrase, c in held[0].items():
        t = held[1][phrase]
        odds = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((c + 0.5) / (clean - c + 0.5))
        if c > t and odds <= -ODDS and _evidence(t, c, toxic, clean) >= EVIDENCE:
            found.add(phrase)
    return found


def learn_lexicon(sample: Sample) -> Lexicon:
    toxic, clean = sample.labels.count(1), sample.labels.count(0)
    if not toxic or not clean:
        return Lexicon({}, [], None)
    # What toxic documents hold often enough is counted first: only that is looked for in the clean ones.
    words_of = [sorted(set(fold(t).split())) if y else None for t, y in zip(sample.texts, sample.labels, strict=True)]
    often = Counter()
    for words in words_of:
        if words:
            often.update(f" {w} " for w in words)
            often.update({f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n})
    often = Counter({e: t for e, t in often.items() if t >= 3})
    rarely = Counter()
    kinds: dict[str, set[str]] = {}
    for text, y in zip(sample.texts, sample.labels, strict=True):
        if not y:
            words = set(fold(text).split())
            rarely.update(e for w in words if (e := f" {w} ") in often)
            rarely.update({e for w in words for n in BEGINNINGS if len(w) > n and (e := f" {w[:n]}") in often})
    chosen: dict[str, tuple[float, float]] = {}
    for e, t in often.items():
        c = rarely[e]
        odds = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((c + 0.5) / (clean - c + 0.5))
        if t > c and odds >= ODDS and (g := _evidence(t, c, toxic, clean)) >= EVIDENCE:
            chosen[e] = (g, odds)
    # A beginning needs several words of its own, and more evidence than each of them.
    for words in words_of:
        for w in words or ():
            for n in BEGINNINGS:
                if len(w) > n and f" {w[:n]}" in chosen:
                    kinds.setdefault(f" {w[:n]}", set()).add(f" {w} ")
    for e, words in kinds.items():
        best = max((chosen.get(w, (0.0, 0.0))[0] for w in words), default=0.0)
        if len(words) < 3 or chosen[e][0] < 1.2 * best:
            del chosen[e]
    entries = {e: odds for e, (_, odds) in sorted(chosen.items(), key=lambda x: -x[1][0])[:ENTRIES]}
    exceptions = sorted({f" {' '.join(fold(p).split())} " for p in HARMLESS} | _harmless(sample, entries, toxic, clean))
    lexicon = Lexicon(entries, exceptions, None)
    x = np.array([lexicon.features(t) for t in sample.texts])
    y = np.array(sample.labels, float)
    weight = np.array([sample.weight[v] for v in sample.labels])
    lexicon.curve = fitted_curve(x, y, weight * len(y) / weight.sum())
    return lexicon


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, held_out, text)."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            scores = [held.value.score(t) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= TOXIC_FROM) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return in_arrow(docs.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def predict_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), learned from ``labels``."""
    sample = labelled_sample(docs, labels, "toxic", ~held_out(4, 2))
    return score_documents(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), learn_lexicon(sample))
