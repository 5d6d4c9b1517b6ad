"""Known URLs, upserts and updates: a new snapshot of a table from the old one and a batch. Plain files know no MERGE; a published table
(:mod:`..sources.published`) takes the snapshot by ``replace``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import ranged


def known_urls(articles: DataFrame, scored: DataFrame) -> DataFrame:
    return articles.select("url").union(scored.select("url")).distinct()


def fresh(fetched: DataFrame, articles: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows whose URL neither the articles nor the scored URLs hold. A null URL is in no table and stays."""
    return fetched.join(known_urls(articles, scored), "url", "left_anti")


def upsert_keys(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every key of the batch is there afterwards; old rows stay as they are."""
    new = keys.select(key).where(F.col(key).isNotNull()).distinct().join(old, key, "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def upsert_subscribers(old: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """The last payload of an email replaces the row but for created_at; updated_at is renewed; addresses without @ are refused; no
    categories means all. ``new`` has email, categories, custom_category, utm_source and pos (order of arrival)."""
    last = pick(new.where(F.contains("email", F.lit("@"))), ["email"], [F.col("pos").desc()]).drop("pos")
    last = last.withColumn("categories", F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("all")))).withColumn("given", F.lit(True))
    o, n = old.alias("o"), last.alias("n")
    keep = lambda c: F.when(F.col("n.given"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    at = F.lit(as_of).cast("timestamp")
    return o.join(n, F.col("o.email") == F.col("n.email"), "full").select(
        F.coalesce("o.email", "n.email").alias("email"),
        *(keep(c) for c in ("categories", "custom_category", "utm_source")),
        F.coalesce("o.created_at", at).alias("created_at"),
        F.when(F.col("n.given"), at).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def update(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Column updates by key; null changes leave the value."""
    c = changes.select(F.col(key).alias("k"), *[F.col(x).alias(f"new_{x}") for x in columns])
    out = old.join(c, F.col(key) == F.col("k"), "left")
    return out.select(*[F.coalesce(f"new_{x}", x).alias(x) if x in columns else F.col(x) for x in old.columns])


def update_set(old: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sparse updates: ``changes`` has a ``<column>_set`` flag for each column, so that an explicit null is written."""
    c = changes.select(F.col(key).alias("k"), *[F.col(x).alias(f"new_{x}") for x in columns], *[f"{x}_set" for x in columns])
    out = old.join(c, F.col(key) == F.col("k"), "left")
    return out.select(*[F.when(F.col(f"{x}_set"), F.col(f"new_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in old.columns])


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null isn't."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the keys in ``gone``, and children without theirs."""
    dead = gone.select(F.col(key).alias(owner)).distinct()
    return delete_keys(parents, gone, key), children.join(dead, owner, "left_anti")


def conflicts(users: DataFrame, key: str = "id", column: str = "email") -> DataFrame:
    """Rows that share ``column`` with a row of another key: such values are found by a count, not by pairs."""
    shared = users.groupBy(column).agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select(column)
    return users.join(shared, column, "left_semi")


def add_if_absent(df: DataFrame, row: DataFrame, key: str) -> DataFrame:
    return df.unionByName(row.join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def numbered(df: DataFrame, order: str, by: str | None = None, column: str = "number") -> DataFrame:
    """Running numbers from 1 in ``order``, which is unique (within ``by`` if given).

    Rows are range-sorted over partitions and stored; partitions are counted and each is numbered from its offset, so no task sees all
    rows or all of a value of ``by``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col(by).alias("by")) if by else F.struct(F.lit(0).alias("by"))
    rows = ranged(df.withColumn("_by", key), parts, ["_by", order], "_part", "numbered")
    counts = rows.groupBy("_part", "_by").agg(F.count("*").alias("n"))  # a row per partition and value of ``by`` in it
    earlier = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_by", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part", "_by").orderBy(order))
    return rows.withColumn("_place", place).join(offsets, ["_part", "_by"]).withColumn(column, F.col("_offset") + F.col("_place")).drop("_part", "_by", "_offset", "_place")


def next_ids(df: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` numbered in ``order`` from the largest key of ``df`` on, without gaps."""
    start = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("_start"))  # one row
    return numbered(rows, order, column=key).crossJoin(F.broadcast(start)).withColumn(key, F.col("_start") + F.col(key)).drop("_start")


def with_uuid(df: DataFrame, column: str = "id") -> DataFrame:
    """A random key for every row; store the result before it is used twice, since each evaluation draws anew."""
    return df.withColumn(column, F.uuid())


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def argmax(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """The row of largest value per key, the first of equals. The aggregate is combined before the shuffle, so a hot key costs little."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(value), (-F.col(pos)).alias("p")))
    return df.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def first_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("b")).select(key, "b.*")


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("b")).select(key, "b.*")
