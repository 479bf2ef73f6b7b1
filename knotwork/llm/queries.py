"""The registered queries of this subpackage, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm._shared import table
from knotwork.llm.bpe import round_trip_digests
from knotwork.llm.decontamination import contaminated
from knotwork.llm.html_extract import main_texts
from knotwork.llm.jaccard_join import near_duplicate_classes
from knotwork.llm.language_id import predict_languages
from knotwork.llm.license_scan import scan
from knotwork.llm.quality import predict_quality
from knotwork.llm.suffix_dedup import repeated_bytes
from knotwork.llm.topk_search import top_k
from knotwork.llm.toxicity import predict_toxicity


def vocabulary_path() -> str:
    """Where the public vocabulary files are kept says their own package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, (SELECT count(*) FROM l WHERE l.a = s.doc_id) AS n_links
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(w) AS l, unnest(range(1, len(w) - 3)) AS p, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS s FROM d WHERE len(w) >= 5),
b AS (SELECT item_id, any_value(l) AS l, s, count(*) AS c FROM (SELECT item_id, len(w) AS l, unnest([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]) AS s FROM i WHERE len(w) >= 5) GROUP BY item_id, s),
h AS (SELECT doc_id, item_id, g.l AS dl, b.l AS il, least(g.l, b.l) - 4 AS n, p FROM g JOIN b USING (s)),
z AS (SELECT DISTINCT doc_id, item_id, dl, il, n, unnest(range(greatest(1, p - n + 1), least(p, dl - 4 - n + 1) + 1)) AS st FROM h),
c AS (SELECT z.doc_id, z.item_id, dl, il, n, st, s, count(*) AS c FROM z JOIN g ON g.doc_id = z.doc_id AND p BETWEEN st AND st + n - 1 GROUP BY ALL),
m AS (SELECT c.doc_id, c.item_id, dl, il, n, st, CAST(sum(least(c.c, b.c)) AS BIGINT) AS low FROM c JOIN b ON b.item_id = c.item_id AND b.s = c.s GROUP BY ALL),
r AS (SELECT *, n + il - 4 - low AS high FROM m WHERE 100 * low >= 75 * (n + il - 4 - low)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY low / CAST(high AS DOUBLE) DESC, st) AS k FROM r)
SELECT doc_id, item_id, low / CAST(high AS DOUBLE) AS similarity, st - 1 AS first_word, least(dl, il) AS n_words FROM k WHERE k = 1
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL = {"op2_ngram_jaccard_join": OP2_SQL, "op7_benchmark_decontamination": OP7_SQL, "op9_exact_top_k": OP9_SQL}
