"""Table schemas of the article store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTICLE = (
    "id bigint, title string, source string, source_type string, url string, published_at timestamp, score int, summary string, "
    "categories array<string>, kind string, content string, embedding array<float>, created_at timestamp"
)
PUBLIC = ("id", "title", "source", "source_type", "url", "published_at", "score", "summary", "categories", "kind", "created_at")
SCORED_URL = "url string, scored_at timestamp"
SUBSCRIBER = "email string, categories array<string>, custom_category string, utm_source string, created_at timestamp, updated_at timestamp"
FETCHED = "title string, url string, content string, published_date string, source string, source_type string"
HN_ITEM = "id bigint, type string, title string, url string, time bigint"
FEED_ENTRY = "title string, link string, summary string, published string, updated string"
REGISTRY = "name string, rssUrl string"
EXPORT = (
    "id bigint, title string, source string, source_type string, url string, published_at string, score int, summary string, "
    "categories array<string>, kind string, content string, created_at string"
)


def add_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Schema evolution: columns that ``df`` lacks, as nulls of the given type."""
    return df.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in df.columns])


def reset_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    """A column rewritten to nulls of a new type."""
    return df.withColumn(column, F.lit(None).cast(kind))
