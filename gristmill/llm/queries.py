"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.boilerplate import furniture
from gristmill.llm.leakage import leak_report, leaks
from gristmill.llm.neardup import NearDuplicates
from gristmill.llm.packing import pack
from gristmill.llm.quality import quality
from gristmill.llm.splitting import oversized, piece_rows
from gristmill.llm.vectors import SimilarVectors
from gristmill.session import read_table

WEB = ("html", "htm")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def web_pages(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).where(F.col("filetype").isin(*WEB))


def near_duplicates(spark: SparkSession, folder: str) -> NearDuplicates:
    return NearDuplicates(documents(spark, folder), similarity=0.6, width=3, min_words=40, unique_ids=True)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return SimilarVectors(read_table(spark, folder, "embed_results"), k=5).close_pairs(0.8)


def p2_top5(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar vectors of every vector whose id is divisible by 50, against all vectors."""
    return SimilarVectors(read_table(spark, folder, "embed_results"), k=5).top(queries=F.col("vec_id") % 50 == 0)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = furniture(web_pages(spark, folder), body=False).select("doc_id", F.explode("furniture").alias("line_no"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"))


def p3_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return furniture(web_pages(spark, folder)).select("doc_id", F.size("furniture").alias("furniture_lines"), "body")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark, folder).pairs().select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of p4_found between distinct texts, each by its smallest id, with similarity and numbers of copies."""
    rows = near_duplicates(spark, folder).representative_pairs()
    return rows.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"), F.round("similarity", 6).alias("similarity"), "copies_a", "copies_b")


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, by five-word runs at similarity 0.8: its group, links and copies; shorter texts by all their words."""
    return NearDuplicates(documents(spark, folder), width=5, min_words=5, unique_ids=True).every_group().withColumnRenamed("id", "doc_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return oversized(documents(spark, folder), read_table(spark, folder, "ingest_specs"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_rows(documents(spark, folder), read_table(spark, folder, "ingest_specs"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of all documents; members of one group of p4_groups never share one."""
    return pack(documents(spark, folder), clusters=p4_groups(spark, folder).select("doc_id", "group"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(documents(spark, folder), read_table(spark, folder, "holdout"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return leak_report(documents(spark, folder), read_table(spark, folder, "holdout"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).where(~F.coalesce(F.col("filetype").isin(*WEB), F.lit(False)))
    return quality(docs, types=False).where("outside_share > 0.5").select("doc_id")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality(documents(spark, folder))


QUERIES = {f.__name__: f for f in (p2_found, p2_top5, p3_found, p3_bodies, p4_found, p4_links, p4_groups, p5_found, p5_pieces, p6_containers, p7_found, p7_report, p8_found, p8_statistics)}

WORD_LIST = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
USABLE = """rows_ AS (SELECT batch_id, model, dim, unnest(vec_ids) AS vec_id, unnest(vectors) AS v FROM embed_results),
good AS (SELECT model, vec_id, arg_min(v, batch_id)::DOUBLE[] AS v FROM rows_ WHERE vec_id IS NOT NULL AND len(v) = dim AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY ALL),
sims AS MATERIALIZED (SELECT a.model, a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM good a JOIN good b ON a.model = b.model AND a.vec_id <> b.vec_id),
tops AS (SELECT *, row_number() OVER (PARTITION BY model, vec_id ORDER BY similarity DESC, other)::INT AS rank FROM sims)"""
LEAKED = f"""dw AS (SELECT doc_id, {WORD_LIST} AS w FROM documents), iw AS (SELECT item_id, suite, {WORD_LIST} AS w FROM holdout),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM dw WHERE len(w) >= 10)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM iw WHERE len(w) >= 10)), leaked AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""
NEAR = f"""w AS (SELECT doc_id, {WORD_LIST} AS w FROM documents), s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 2], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 40)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL), both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)"""

ORACLE = {
    "p5_found": "SELECT d.doc_id FROM documents d JOIN ingest_specs s ON d.corpus = s.documents WHERE length(d.text) > 4 * s.size_tokens",
    "p2_found": f"WITH {USABLE} SELECT DISTINCT least(vec_id, other) AS vec_id_a, greatest(vec_id, other) AS vec_id_b FROM tops WHERE rank <= 5 AND similarity >= 0.8",
    "p2_top5": f"WITH {USABLE} SELECT model, vec_id, other, similarity, rank FROM tops WHERE rank <= 5 AND vec_id % 50 = 0",
    "p4_found": f"WITH {NEAR} SELECT a AS doc_id_a, b AS doc_id_b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.6",
    "p7_found": f"WITH {LEAKED} SELECT * FROM leaked",
    "p7_report": f"WITH {LEAKED}, first_of AS (SELECT item_id, min(suite) AS suite FROM holdout GROUP BY ALL) SELECT item_id, count(*) AS docs, min(doc_id) AS first_doc, any_value(suite) AS suite FROM leaked JOIN first_of USING (item_id) GROUP BY item_id",
}
