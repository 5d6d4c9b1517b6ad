"""Readers of feed snapshots: what a fetcher stored, as rows of FETCHED. The network is the fetcher's business."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import dates, markup, text, urls

HN_ITEMS = 200


def hacker_news(top: DataFrame, items: DataFrame, as_of: datetime) -> DataFrame:
    """top (ids array<bigint>) and items (HN_ITEM): stories with a title on the topic within the window, in list order (pos)."""
    ids = top.select(F.posexplode(F.slice("ids", 1, HN_ITEMS)).alias("pos", "id"))
    at = dates.from_epoch(F.col("time"))
    rows = ids.join(items, "id").where("type = 'story' and title <> ''").where(text.keyword_match(F.col("title")))
    return rows.where(dates.within_window(at, as_of)).select(
        text.clean_title(F.col("title")).alias("title"),
        urls.discussion_url(F.col("url"), F.col("id")).alias("url"),
        F.lit("").alias("content"),
        dates.iso_text(F.coalesce(at, F.lit(as_of))).alias("published_date"),
        F.lit("Hacker News").alias("source"),
        F.lit("hackerNews").alias("source_type"),
        F.col("pos").cast("long").alias("pos"),
    )


def recap_feed(xml: DataFrame, as_of: datetime) -> DataFrame:
    """xml (xml string): the stories of the recap issues within the window; a URL's first story wins."""
    items = xml.select(F.posexplode(markup.feed_items(F.col("xml"))).alias("issue", "i")).select("issue", "i.*")
    items = items.where(dates.within_window(dates.parse(F.col("pub_date")), as_of)).where(~text.is_quiet_issue(F.col("title")))
    html = items.withColumn("html", markup.decoded(F.col("content_html")))
    post = F.filter(F.array(markup.post_recap(F.col("html"))), lambda x: x.isNotNull())
    stories = html.select("issue", "pub_date", F.posexplode(F.concat(post, markup.thread_recap(F.col("html")))).alias("n", "s"))
    from ..operators.state import first_wins

    rows = stories.select(
        "s.title", "s.url", "s.content", F.col("pub_date").alias("published_date"), F.lit("AI News").alias("source"), F.lit("aiNews").alias("source_type"),
        (F.col("issue") * 100_000 + F.col("n")).cast("long").alias("pos"),
    )
    return first_wins(rows, "url", "pos").select("title", "url", "content", "published_date", "source", "source_type", "pos")


def newsletter_feeds(entries: DataFrame, as_of: datetime) -> DataFrame:
    """entries (FEED_ENTRY, name, feed, entry): the registry's feed entries within the window. Position is (feed, entry) and not the order of arrival."""
    e = lambda c: F.nullif(F.col(c), F.lit(""))
    date = F.coalesce(e("published"), e("updated"), F.lit(""))
    return entries.where(dates.within_window(dates.parse(date), as_of)).select(
        text.or_empty(F.col("title"), "(no title)").alias("title"),
        text.or_empty(F.col("link"), "").alias("url"),
        text.or_empty(F.col("summary"), "").alias("content"),
        date.alias("published_date"),
        F.col("name").alias("source"),
        F.lit("rss").alias("source_type"),
        (F.col("feed") * 100_000 + F.col("entry")).cast("long").alias("pos"),
    )


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.REGISTRY).option("multiLine", True).json(path)


def export(spark: SparkSession, path: str) -> DataFrame:
    """An article export: dates parsed, and whether a row can be shown (a score and a summary)."""
    rows = spark.read.schema(schema.EXPORT).option("multiLine", True).json(path)
    rows = rows.withColumns({c: dates.iso(F.col(c)) for c in ("published_at", "created_at")})
    return rows.withColumn("complete", F.col("score").isNotNull() & (F.coalesce("summary", F.lit("")) != ""))


def union(*feeds: DataFrame) -> DataFrame:
    """All feeds, with rank of the feed before position, so that an earlier feed wins a URL."""
    out = None
    for rank, f in enumerate(feeds):
        f = f.withColumn("rank", F.lit(rank))
        out = f if out is None else out.unionByName(f)
    return out
