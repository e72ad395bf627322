"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import alignment, bpe, decontaminate, language, lexical, licences, lm_score, near_dedup, private_data, simhash, substrings, token_counts, topk
from tallyspark.llm.textkit import read

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@register
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()).select("text", "lang"))
    out = language.predict(docs.select("doc_id", "text"), model, spans=False)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@register
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


@register
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("rk")


@register
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), keep_ids=False)


@register
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


ORACLE["op1_topk"] = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@register
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"), keep_text=False).drop("spans")


@register
def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.report(private_data.find(read(spark, sf_dir, "documents")))


@register
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.scores(read(spark, sf_dir, "documents"))
    return out.withColumn("lm_score", F.round("lm_score", 4))


# Words, counts without the text's own, and backoff as in lm_score, word by word in plain joins.
ORACLE["op6_lm_score"] = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM texts),
spots AS (SELECT r, i, c, lag(c) OVER s AS b, lag(c, 2) OVER s AS a FROM words WINDOW s AS (PARTITION BY r ORDER BY i)),
o1 AS (SELECT r, c, count(*) AS n FROM spots GROUP BY ALL), c1 AS (SELECT c, sum(n) AS n FROM o1 GROUP BY ALL),
o2 AS (SELECT r, b, c, count(*) AS n FROM spots WHERE b IS NOT NULL GROUP BY ALL), c2 AS (SELECT b, c, sum(n) AS n FROM o2 GROUP BY ALL),
o3 AS (SELECT r, a, b, c, count(*) AS n FROM spots WHERE a IS NOT NULL GROUP BY ALL), c3 AS (SELECT a, b, c, sum(n) AS n FROM o3 GROUP BY ALL),
size AS (SELECT r, count(*) AS n FROM words GROUP BY 1), every AS (SELECT count(*) AS n FROM words),
judged AS (
  SELECT s.r, s.a, s.b, every.n - size.n AS others, c1.n - o1.n AS uni, coalesce(c2.n - o2.n, 0) AS bi, coalesce(c3.n - o3.n, 0) AS tri,
         p1.n - q1.n AS before1, p2.n - q2.n AS before2
  FROM spots s JOIN size USING (r) CROSS JOIN every
  JOIN c1 ON c1.c = s.c JOIN o1 ON o1.r = s.r AND o1.c = s.c
  LEFT JOIN c2 ON c2.b = s.b AND c2.c = s.c LEFT JOIN o2 ON o2.r = s.r AND o2.b = s.b AND o2.c = s.c
  LEFT JOIN c3 ON c3.a = s.a AND c3.b = s.b AND c3.c = s.c LEFT JOIN o3 ON o3.r = s.r AND o3.a = s.a AND o3.b = s.b AND o3.c = s.c
  LEFT JOIN c1 p1 ON p1.c = s.b LEFT JOIN o1 q1 ON q1.r = s.r AND q1.c = s.b
  LEFT JOIN c2 p2 ON p2.b = s.a AND p2.c = s.b LEFT JOIN o2 q2 ON q2.r = s.r AND q2.b = s.a AND q2.c = s.b
), valued AS (
  SELECT r, (a IS NOT NULL AND tri = 0) OR (a IS NULL AND b IS NOT NULL AND bi = 0) AS cut,
    CASE WHEN tri > 0 THEN tri / before2
         WHEN bi > 0 THEN (CASE WHEN a IS NULL THEN 1 ELSE 0.4 END) * (bi / before1)
         ELSE (CASE WHEN b IS NULL THEN 1 WHEN a IS NULL THEN 0.4 ELSE 0.4 * 0.4 END) * (CASE WHEN uni > 0 THEN uni / others ELSE 1 / (others + 1) END) END AS v
  FROM judged
), summed AS (SELECT r, count(*) AS n, count(*) FILTER (cut) AS cuts, avg(ln(v)) AS score FROM valued GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(cuts, 0) AS n_backoff, round(score, 4) AS lm_score FROM texts LEFT JOIN summed USING (r)
"""


@register
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


ORACLE["op8_licences"] = licences.oracle()


@register
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE["op11_lexical"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), asked AS (
  SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM texts) GROUP BY ALL),
size AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM texts WHERE len(w) > 0),
frequency AS (SELECT term, count(*) AS df FROM counted GROUP BY 1),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * df + 1))) AS BIGINT) AS w FROM frequency, size),
lengths AS (SELECT r, doc_id, 25 + (75 * len(w) * N) // L AS m FROM texts, size WHERE len(w) > 0),
uses AS (SELECT i, term, count(*) AS u FROM (SELECT i, unnest(w) AS term FROM asked) GROUP BY ALL),
scored AS (
  SELECT i, r, doc_id, CAST(sum(u * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM uses JOIN weighed USING (term) JOIN counted USING (term) JOIN lengths USING (r) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored JOIN asked USING (i) WHERE score > 0 QUALIFY rank <= 10
"""


@register
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@register
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))
