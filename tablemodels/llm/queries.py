"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.llm import (
    decontaminate, html_text, multi_index, packing, quality, shared_search, simhash, substring, token_files, token_pairs, topk,
    url_filter, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

END_ID = 2
QUALITY_CUT = 0.3
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


OP6_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format('text')}, '{TERM}') AS t FROM documents
), held AS (
    SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0
), corpus AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM held
), tf AS (
    SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM held) GROUP BY r, term
), w AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), corpus
), item AS (
    SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all({LOWER.format('text')}, '{TERM}')) AS t FROM benchmark
), wanted AS (
    SELECT i, item_id, unnest(t) AS term FROM item
), scored AS (
    SELECT i, item_id, r, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
    FROM wanted JOIN w USING (term) JOIN tf USING (term) JOIN held USING (r), corpus
    GROUP BY i, item_id, r, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_best_fit_packing")
def _(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", END_ID, capacity=1024)


@query("op4_token_files")
def _(spark, sf_dir):
    folder, manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), "word_bpe_49k.json", END_ID)
    return token_files.read_token_files(spark, folder, manifest)


@query("op10_simhash_components")
def _(spark, sf_dir):
    return simhash.near_components(table(spark, sf_dir, "documents"), shingle=3, budget=2)


@query("op7_substring_dedup")
def _(spark, sf_dir):
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    found = F.col("_repeats")
    return cut.select("doc_id", found["n_words"].alias("n_words"), found["n_removed"].alias("n_removed"),
                      substring.kept_sha256(found).alias("kept_sha256"))


@query("op3_line_crf_quality")
def _(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"),
                         quality.quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_CUT).cast("int"))


@query("op1_warc_salvage")
def _(spark, sf_dir):
    folder, _ = warc.write_warc(warc.with_record_types(table(spark, sf_dir, "pages")))
    read = warc.read_warc(spark, folder).filter("kind = 'record'")
    own = F.col("payload").isNotNull()
    return read.select(
        "page_id",
        F.when(own, F.octet_length("payload")).otherwise(F.col("stated_bytes")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@query("op5_article_text")
def _(spark, sf_dir):
    text = html_text.extract(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


@query("op6_maxscore_topk", OP6_SQL)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), topk.scaled(F.col("embedding"), 256).alias("v")
    )
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL")
    found = topk.top_products(rows.filter("id % 50 = 0"), rows, k=5)
    return found.withColumnRenamed("id", "vec_id")


@query("op8_url_logistic_filter")
def _(spark, sf_dir):
    model = url_filter.train(url_filter.labelled_urls(spark))
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_template_decontamination")
def _(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("_text_hash")


@query("op11_shared_term_search", OP11_SQL)
def _(spark, sf_dir):
    return shared_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=10)


@query("op12_pair_bitmap_alignment")
def _(spark, sf_dir):
    return token_pairs.align(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")


@query("op13_inverted_multi_index")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), multi_index.usable(F.col("embedding")).alias("v")
    )
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL")
    found = multi_index.nearest(rows.filter("id % 100 = 0"), rows, k=10)
    return found.withColumnRenamed("id", "vec_id")
