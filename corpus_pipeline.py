"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Language ID rejects what has no letter; the near-duplicate join leaves the first document of each class; the
suffix dedup takes repeated passages out of the texts; decontamination rejects documents that hold a benchmark
item; BPE encodes what is left. ORACLE_SQL is None: learned profiles and byte-pair merges are beyond SQL, and
the stages are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm._shared import cut, table
from knotwork.llm.bpe import round_trip_digests
from knotwork.llm.decontamination import without_contaminated
from knotwork.llm.jaccard_join import one_of_each_class
from knotwork.llm.language_id import held_out, identify, learn_profiles
from knotwork.llm.queries import vocabulary_path
from knotwork.llm.suffix_dedup import without_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a language is found."""
    docs = docs.select(*COLUMNS)
    return identify(docs, learn_profiles(docs.where(~held_out(5, 0)))).where("lang_pred <> 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: the one of smallest doc_id, nulls last, once."""
    return one_of_each_class(docs.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the repeated passages out of the texts; what falls apart at a character's bytes is left out whole."""
    return without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return round_trip_digests(docs, vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
