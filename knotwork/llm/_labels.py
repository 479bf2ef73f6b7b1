"""Bounded samples of labelled documents, for the models that are trained here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model may be fitted on: of each class, and their longest text in bytes.
EACH, LONGEST = 3000, 32768


@dataclass
class Sample:
    """Texts, their labels, and for each label how many labelled documents one of the sample stands for."""

    texts: list[str]
    labels: list[int]
    weight: dict[int, float]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, each: int = EACH, longest: int = LONGEST) -> Sample:
    """Up to ``each`` documents of either class, those of the least hash of doc_id, among the ``allowed`` ones.

    Of several labels of a document the greatest counts, of several texts the least; null labels, null doc_ids and null texts are left out.
    The sample is 2 * each rows of ``longest`` bytes at most, however large the tables are.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed).groupBy("doc_id").agg(F.max(label).alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    short = docs.where(F.octet_length("text") <= longest).select("doc_id", "text")
    texts, ys, weight = [], [], {}
    for y in sorted(sizes):
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each).select("doc_id")
        rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
        texts += [r["text"] for r in rows]
        ys += [y] * len(rows)
        weight[y] = sizes[y] / max(1, len(rows))
    return Sample(texts, ys, weight)
