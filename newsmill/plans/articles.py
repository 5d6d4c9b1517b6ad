"""The article view over the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2026, 6, 29)
CREATED = datetime(2026, 1, 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def articles(spark: SparkSession, sf_dir: str, url: bool = True, embedding: bool = False) -> DataFrame:
    """The view, with the columns that cost a join only where they are asked for."""
    docs = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    names = lambda c, *xs: F.get(F.array(*[F.lit(x) for x in xs]), c.cast("int"))
    lists = [("models",), ("dev",), ("research",), ("models", "dev"), ("dev", "research"), ("models", "research")]
    categories = F.get(F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in lists]), (i % 6).cast("int"))
    d = docs
    if url:
        pages = read(spark, sf_dir, "pages")
        d = d.crossJoin(F.broadcast(pages.agg(F.count("*").alias("n_pages")))).withColumn("page_id", i % F.col("n_pages")).join(pages.select("page_id", "url"), "page_id", "left")
    if embedding:
        d = d.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return (
        d.select(
            i.alias("id"),
            F.translate(F.substring("text", 1, 60), "\n", " ").alias("title"),
            "source",
            names(i % 3, "aiNews", "rss", "hackerNews").alias("source_type"),
            *(["url"] if url else []),
            F.when(i % 23 != 0, F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(hours=(i * 2 % 1000).cast("int"))).alias("published_at"),
            F.when(i % 17 != 0, (i * 37 % 100 + 1).cast("int")).alias("score"),
            F.concat(F.lit("about "), F.substring("text", 1, 20)).alias("summary"),
            F.when(i % 29 != 0, categories).alias("categories"),
            names(i % 6, "repo", "paper", "model", "blog", "product", "announcement").alias("kind"),
            F.col("text").alias("content"),
            *(["embedding"] if embedding else []),
            (F.lit(CREATED).cast("timestamp_ntz") + F.make_dt_interval(mins=i.cast("int"))).alias("created_at"),
        )
    )


SQL = """
articles AS (
  SELECT doc_id AS id, translate(substring(text, 1, 60), chr(10), ' ') AS title, source,
    CASE doc_id % 3 WHEN 0 THEN 'aiNews' WHEN 1 THEN 'rss' ELSE 'hackerNews' END AS source_type, url,
    CASE WHEN doc_id % 23 <> 0 THEN TIMESTAMP '2026-06-29 00:00:00' - to_hours(CAST(doc_id * 2 % 1000 AS INTEGER)) END AS published_at,
    CASE WHEN doc_id % 17 <> 0 THEN CAST(doc_id * 37 % 100 + 1 AS INTEGER) END AS score,
    'about ' || substring(text, 1, 20) AS summary,
    CASE WHEN doc_id % 29 <> 0 THEN CASE doc_id % 6 WHEN 0 THEN ['models'] WHEN 1 THEN ['dev'] WHEN 2 THEN ['research'] WHEN 3 THEN ['models', 'dev']
      WHEN 4 THEN ['dev', 'research'] ELSE ['models', 'research'] END END AS categories,
    CASE doc_id % 6 WHEN 0 THEN 'repo' WHEN 1 THEN 'paper' WHEN 2 THEN 'model' WHEN 3 THEN 'blog' WHEN 4 THEN 'product' ELSE 'announcement' END AS kind,
    text AS content, embedding, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages) LEFT JOIN embeddings e ON e.vec_id = d.doc_id)
"""
