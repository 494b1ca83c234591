"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import language
from cohortloom.llm.decontaminate import find_leaks
from cohortloom.llm.exact_dedup import exact_duplicates
from cohortloom.llm.html_text import extract
from cohortloom.llm.lexical_search import search
from cohortloom.llm.lm_score import score as lm_score
from cohortloom.llm.ngram_join import similar_sets
from cohortloom.llm.packing import pack
from cohortloom.llm.quality import resample
from cohortloom.llm.repeated_passages import repeated_passages
from cohortloom.llm.token_alignment import align
from cohortloom.llm.tokens import token_counts
from cohortloom.llm.toxicity import fit, score

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents")).drop("text_hash")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_read(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_read(spark, sf_dir, "documents")).documents()


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_join, op2_decontamination, op3_exact_dedup, op4_quality, op5_repeated_passages, op6_token_counts, op7_packing, op8_lm_scores, op9_html_text, op10_toxicity, op11_token_alignment, op12_lexical_search, op13_language)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_SQUEEZED = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

ORACLES: dict[str, str] = {
    "op1_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s
            FROM w
        ), d AS (
            SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS set_id FROM s
        ), r AS MATERIALIZED (
            SELECT set_id, len(s) AS n, s FROM d WHERE doc_id = set_id AND len(s) > 0
        ), t AS MATERIALIZED (
            SELECT set_id, n, hash(x) AS x FROM (SELECT set_id, n, unnest(s) AS x FROM r)
        ), p AS MATERIALIZED (
            SELECT a.set_id AS a, b.set_id AS b FROM t a JOIN t b ON a.x = b.x AND a.set_id <> b.set_id
            GROUP BY a.set_id, b.set_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), c AS (
            SELECT a AS origin, a AS node FROM p UNION SELECT c.origin, p.b FROM c JOIN p ON p.a = c.node
        ), m AS (
            SELECT node, min(origin) AS component FROM c GROUP BY node
        ), k AS (
            SELECT a, count(*) AS n_links FROM p GROUP BY a
        )
        SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(m.component, d.set_id) AS component_id, d.set_id,
               coalesce(k.n_links, 0) AS n_links
        FROM d LEFT JOIN m ON m.node = d.set_id LEFT JOIN k ON k.a = d.set_id
    """,
    "op3_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars, sha256({_SQUEEZED}) AS text_sha256 FROM documents
        ), k AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
    """,
    "op12_lexical_search": f"""
        WITH d AS (
            SELECT doc_id, {_TERMS} AS w FROM documents
        ), c AS (
            SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
        ), b AS (
            SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark
        ), o AS MATERIALIZED (
            SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d)
            WHERE t IN (SELECT t FROM b) GROUP BY ALL
        ), v AS (
            SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, c GROUP BY t
        ), s AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM b JOIN o USING (t) JOIN v USING (t), c GROUP BY item_id, doc_id HAVING score > 0
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
        FROM s QUALIFY rank <= 10
    """,
}
