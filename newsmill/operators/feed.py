"""Feed, search and statistics over the article table."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import dates, vectors

MOST = 50


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be within 1 and {MOST}")
    return limit


def feed_filter(
    articles: DataFrame, as_of: datetime, since: str | None = None, min_score: int | None = None, category: str | None = None, kind: str | None = None
) -> DataFrame:
    """The feed's predicates: a score, a date from ``since`` on (30 days back if it is missing or malformed), and the optional ones."""
    out = articles.where(F.col("score").isNotNull() & (F.col("published_at") >= F.lit(dates.since_or_default(since, as_of))))
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if category is not None:
        out = out.where(F.array_contains("categories", category))
    return out


def feed(articles: DataFrame, as_of: datetime, limit: int = 20, sort: str = "score", **filters) -> DataFrame:
    """The page: public columns, by score (also for an unknown sort) or by date, ties by id."""
    score = filters.get("min_score")
    if score is not None and not 1 <= score <= 10:
        raise ValueError("min_score must be within 1 and 10")
    by = "published_at" if sort == "published_at" else "score"
    rows = feed_filter(articles, as_of, **filters).select(*schema.PUBLIC)
    return rows.orderBy(F.col(by).desc(), "id").limit(check_limit(limit))


def feed_count(articles: DataFrame, as_of: datetime, **filters) -> DataFrame:
    """All matches, before any limit."""
    return feed_filter(articles, as_of, **filters).agg(F.count("*").alias("count"))


def search(articles: DataFrame, query: list[float], limit: int = 20) -> DataFrame:
    """The nearest articles with a score by exact cosine distance; no other filter holds in a search."""
    q = F.array(*[F.lit(float(x)) for x in query])
    found = articles.where(F.col("score").isNotNull() & F.col("embedding").isNotNull())
    return found.select(*schema.PUBLIC, vectors.cosine_distance(F.col("embedding"), q).alias("distance")).orderBy("distance", "id").limit(check_limit(limit))


def browse(articles: DataFrame, as_of: datetime, search_text: str | None = None, embed=None, limit: int = 20, **filters) -> DataFrame:
    """What a reader's list shows: with a search text the search alone, whatever the filters say; else the feed."""
    if search_text:
        vector = embed(pd.DataFrame({"id": [0], "text": [search_text]})).embedding.iloc[0]
        return search(articles, list(vector), limit)
    return feed(articles, as_of, limit, **filters)


def found_count(found: DataFrame) -> DataFrame:
    """A search counts the rows it returns."""
    return found.agg(F.count("*").alias("count"))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows with one of ``keys``: one join, whatever their number."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def first_where(df: DataFrame, column: str, value, order: str) -> DataFrame:
    """The first row with a value, or none."""
    return df.where(F.col(column) == F.lit(value)).orderBy(order).limit(1)


#: Queries and vectors whose distances are held at once (8 MB a matrix), and queries that are sent to every task at most.
TILE, QUERIES = (512, 2048), 16_384


class Nearest:
    """For each query the ``k`` nearest of all vectors added so far: by distance (rounded to ``digits`` if given), NaN last, ties by id. It holds the
    queries, their k best and one tile of distances, however many vectors are added."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, digits: int | None):
        self.query_ids, self.queries, self.k, self.digits = query_ids, queries, k, digits
        n = len(query_ids)
        self.norms = np.linalg.norm(queries, axis=1) if n else np.zeros(0)
        self.held, self.distances, self.ids = np.zeros(n, np.int64), np.full((n, k), np.inf), np.zeros((n, k), np.int64)  # NaN is held as infinity

    def add(self, ids: np.ndarray, x: np.ndarray, mine: np.ndarray | None = None) -> None:
        """Vectors, for the queries at the places ``mine`` (all of them if not given)."""
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        norms = np.linalg.norm(x, axis=1)
        mine = np.arange(len(self.query_ids)) if mine is None else mine
        for i in range(0, len(mine), TILE[0]):
            at = mine[i : i + TILE[0]]
            q, q_norms = self.queries[at], self.norms[at][:, None]
            for j in range(0, len(ids), TILE[1]):
                d = q @ x[j : j + TILE[1]].T
                with np.errstate(divide="ignore", invalid="ignore"):
                    d /= q_norms
                    d /= norms[j : j + TILE[1]]
                np.subtract(1, d, out=d)
                if self.digits is not None:
                    np.round(d, self.digits, out=d)
                d[np.isnan(d)] = np.inf
                self._merge(at, d, ids[j : j + TILE[1]])

    def _merge(self, at: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        k = self.k
        bound = self.distances[at, -1:]
        if d.shape[1] > k and np.isinf(bound).any():
            bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        close = d <= bound
        if close.sum() > 4 * k * len(at):  # of equal ones at the bound, k with the smallest ids are enough
            tie = d == bound
            close &= ~tie | (np.cumsum(tie, axis=1) <= k)
        r, c = np.nonzero(close)
        if not len(r):
            return
        rows, new = np.unique(r, return_counts=True)
        old = at[rows]
        row = np.concatenate([np.repeat(rows, k), r])
        distance = np.concatenate([self.distances[old].ravel(), d[r, c] + 0.0])  # no negative zero
        which = np.concatenate([self.ids[old].ravel(), ids[c]])
        free = np.concatenate([(np.arange(k) >= self.held[old][:, None]).ravel(), np.zeros(len(r), bool)])
        order = np.lexsort((which, distance, free, row))
        best = order[np.searchsorted(row[order], rows)[:, None] + np.arange(k)]
        self.distances[old], self.ids[old], self.held[old] = distance[best], which[best], np.minimum(k, self.held[old] + new)

    def frame(self) -> pd.DataFrame:
        """query_id, id, distance: up to ``k`` rows for each query."""
        full = np.arange(self.k) < self.held[:, None]
        d = self.distances[full]
        return pd.DataFrame({"query_id": np.repeat(self.query_ids, self.held), "id": self.ids[full], "distance": np.where(np.isinf(d), np.nan, d)})


def _matrix(embeddings: pd.Series) -> np.ndarray:
    return np.stack(embeddings.to_numpy()).astype(float)


def search_batch(vectors_: DataFrame, queries: DataFrame, k: int, query_rows: int = QUERIES, vector_rows: int = 16384, digits: int | None = None) -> DataFrame:
    """query_id, id, distance, rank: the k nearest of ``vectors_`` (id, embedding) for each of ``queries`` (query_id, embedding), exactly.

    Up to ``query_rows`` queries are sent to every task, which returns each query's k best of its rows: vectors aren't shuffled. More
    queries and the vectors are dealt into blocks of bounded size, and a pair of blocks is a task. Distances are made in tiles of fixed size. Best is by
    distance (rounded to ``digits`` if given) and then id. Zero vectors have distance NaN, which sorts last; null vectors are left out.
    """
    given, rows = queries.where("embedding is not null").select("query_id", "embedding"), vectors_.where("embedding is not null").select("id", "embedding")
    n = given.count()
    out = "query_id long, id long, distance double"
    if n <= query_rows:
        few = given.orderBy("query_id").collect()  # query_rows at most
        sent = vectors_.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in few], np.int64), np.array([r.embedding for r in few], float)))

        def near(batches):
            best = Nearest(*sent.value, k, digits)
            for b in batches:
                if len(best.query_ids) and len(b):
                    best.add(b.id.to_numpy(), _matrix(b.embedding))
            yield best.frame()

        found = rows.mapInPandas(near, out)
    else:
        n_q, n_v = -(-n // query_rows), max(1, -(-rows.count() // vector_rows))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        # One schema for both sides: queries are sent to every vector block and vectors to every query block.
        q = given.select(F.lit(True).alias("is_query"), F.col("query_id").alias("id"), "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb"), every(n_v).alias("vb"))
        v = rows.select(F.lit(False).alias("is_query"), "id", "embedding", every(n_q).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(n_v)).alias("vb"))

        def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf.is_query], pdf[~pdf.is_query]
            if a.empty or b.empty:
                return pd.DataFrame({"query_id": [], "id": [], "distance": []})
            best = Nearest(a.id.to_numpy(), _matrix(a.embedding), k, digits)
            best.add(b.id.to_numpy(), _matrix(b.embedding))
            return best.frame()

        found = q.unionByName(v).groupBy("qb", "vb").applyInPandas(nearest, out)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def stats(articles: DataFrame) -> DataFrame:
    """total and last_updated (ISO text, null for an empty table) in one pass."""
    return articles.agg(F.count("*").alias("total"), dates.iso_text(F.max("created_at")).alias("last_updated"))


def page(df: DataFrame, order: str, key: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page by ``order`` descending with nulls first, ties by key."""
    return df.orderBy(F.col(order).desc_nulls_first(), key).offset(skip).limit(limit)


def owned(df: DataFrame, column: str, user, is_superuser: bool = False) -> DataFrame:
    return df if is_superuser else df.where(F.col(column) == user)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
