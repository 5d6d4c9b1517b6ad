"""A stored inverted-file index for nearest-neighbour search by cosine distance.

    path/centroids      (list, centroid): the directions that the lists stand for
    path/lists/list=i/run=r/   (id, embedding): the vectors nearest to centroid i that run r added

The centroids are learnt by k-means on a bounded sample; every vector is indexed. A search reads the folders of the lists that its queries
probe and no others. Adding writes into the folders of the lists concerned, under its run's name, so that a repeated run replaces what its first
try left. Vectors without a direction (zeros) are in list 0; null vectors aren't indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .feed import QUERIES, Nearest, _matrix

#: Vectors that the centroids are learnt from, of these in one task, lists at most, and vectors written by one task.
SAMPLE, LEARNT, LISTS, SHARD = 65_536, 4096, 4096, 100_000


class Index:
    """An index at ``path``; ``centroids`` is a matrix of unit vectors (LISTS rows at most), a row for each list."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # LISTS rows at most
        self.centroids = np.array([r.centroid for r in rows], float)

    @property
    def vectors(self) -> DataFrame:
        """(id, embedding, list, run) of all that is indexed."""
        return self.spark.read.parquet(f"{self.path}/lists")

    def nearest_lists(self, embeddings: pd.Series, probes: int) -> np.ndarray:
        """For each vector its ``probes`` nearest lists, nearest first."""
        return _ranked_lists(self.centroids, embeddings)[:, :probes]


#: Numbers in a matrix of rows by lists (8 MB), and rows that a step which repeats vectors returns at once.
CELLS, ROWS = 1 << 20, 1 << 16


def _tiles(batches, lists: int, probes: int = 1):
    """The batches in pieces that keep a matrix of rows by lists within CELLS, and rows by probes within ROWS."""
    size = max(1, min(CELLS // lists, ROWS // probes))
    for b in batches:
        for i in range(0, len(b), size):
            yield b.iloc[i : i + size]


def _ranked_lists(centroids: np.ndarray, embeddings: pd.Series) -> np.ndarray:
    x = _matrix(embeddings)
    norms = np.linalg.norm(x, axis=1)
    order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")
    order[norms == 0] = np.arange(len(centroids))  # no direction: list 0 first
    return order


def build_index(rows: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 7, run: str = "first") -> Index:
    """An index of ``rows`` (id, embedding) at ``path``, which must not exist yet: ``lists`` lists (the root of the number of rows if not
    given), with centroids from ``sample`` rows at most, drawn by a hash of their ids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    whole = rows.where("embedding is not null").select("id", "embedding")
    n = whole.count()
    lists = min(LISTS, lists or max(1, math.isqrt(n)))
    unit = whole.where(vectors.norm(F.col("embedding")) > 0)
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < math.ceil(min(1.0, 1.2 * sample / max(1, n)) * (1 << 20))
    taken = unit.where(drawn).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    # The limit leaves one partition, in which every round of k-means would be one task.
    dealt = taken.repartition(-(-min(n, sample) // LEARNT), "id") if min(n, sample) > LEARNT else taken
    learnt = dealt.select(array_to_vector(vectors.normalise(F.col("embedding"))).alias("features"))
    if lists == 1 or learnt.limit(2).count() < 2:  # nothing to divide
        first = unit.orderBy(F.xxhash64("id"), "id").select(vectors.normalise(F.col("embedding")).alias("v")).first()
        centres = [first.v if first else [1.0]]
    else:
        centres = KMeans(k=lists, seed=seed, maxIter=12, initSteps=2, distanceMeasure="cosine").fit(learnt.cache()).clusterCenters()
        learnt.unpersist()
    made = [(i, [float(x) for x in np.asarray(c) / (np.linalg.norm(c) or 1)]) for i, c in enumerate(centres)]
    spark.createDataFrame(made, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    index = Index(spark, path)
    add(index, rows, run)
    return index


def _listed(index: Index, rows: DataFrame, name: str, probes: int) -> DataFrame:
    """(name, embedding, list): a row for each of the nearest ``probes`` lists."""
    sent = index.spark.sparkContext.broadcast(index.centroids)

    def place(batches):
        for b in _tiles(batches, len(sent.value), min(probes, len(sent.value))):
            lists = _ranked_lists(sent.value, b.embedding)[:, :probes]
            rank = np.tile(np.arange(lists.shape[1], dtype=np.int32), len(b))
            yield b.loc[b.index.repeat(lists.shape[1])].assign(list=lists.ravel().astype(np.int32), rank=rank)

    return rows.where("embedding is not null").select(name, "embedding").mapInPandas(place, f"{name} long, embedding array<float>, list int, rank int")


def add(index: Index, rows: DataFrame, run: str) -> None:
    """``rows`` (id, embedding) added under the name of ``run``. Only folders of the lists concerned are written; a run of the same name that
    brings the same rows replaces its own files. A list with many of the rows is written by several tasks."""
    listed = _listed(index, rows, "id", 1).drop("rank").withColumn("run", F.lit(run))
    shard = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(rows.count() / SHARD)))).cast("int")
    dealt = listed.repartition(int(index.spark.conf.get("spark.sql.shuffle.partitions")), "list", shard)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list", "run").parquet(f"{index.path}/lists")


def _asked(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, embedding, lists): a row for each query, its ``probes`` nearest lists as set bits, LISTS at most."""
    sent = index.spark.sparkContext.broadcast(index.centroids)

    def place(batches):
        for b in _tiles(batches, len(sent.value)):
            probed = np.zeros((len(b), len(sent.value)), bool)
            np.put_along_axis(probed, _ranked_lists(sent.value, b.embedding)[:, :probes], True, axis=1)
            yield b.assign(lists=[bits.tobytes() for bits in np.packbits(probed, axis=1)])

    given = queries.where("embedding is not null").select("query_id", "embedding").dropDuplicates(["query_id"])
    return given.mapInPandas(place, "query_id long, embedding array<float>, lists binary")


def search(index: Index, queries: DataFrame, k: int, probes: int, query_rows: int = QUERIES, digits: int | None = None) -> DataFrame:
    """query_id, id, distance, rank: for each of ``queries`` (query_id, embedding) the ``k`` nearest vectors of its ``probes`` nearest
    lists; with as many probes as lists this is the exact answer. Ties by id; zero vectors have distance NaN, which sorts last.

    Which lists are probed is known before the vectors are read (LISTS numbers at most), so other folders are pruned. Up to ``query_rows``
    queries are sent to every task, each once with its lists as bits, and vectors aren't shuffled; more queries are taken in as many rounds of pieces
    by a hash of their ids.
    """
    if probes < 1:
        raise ValueError("probes must be at least 1")
    pieces = max(1, -(-queries.count() // query_rows))
    found = None
    for i in range(pieces):
        part = queries if pieces == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == i)
        now = _search_few(index, _asked(index, part, probes), k, digits)
        found = now if found is None else found.unionByName(now)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_few(index: Index, asked: DataFrame, k: int, digits: int | None) -> DataFrame:
    few = asked.collect()  # some query_rows at most
    lists = len(index.centroids)
    bits = np.array([np.frombuffer(r.lists, np.uint8) for r in few], np.uint8).reshape(len(few), -(-lists // 8))
    probed = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=lists)).tolist()
    sent = index.spark.sparkContext.broadcast((np.array([r.query_id for r in few], np.int64), np.array([r.embedding for r in few], float), bits))
    rows = index.vectors.where(F.col("list").isin(probed)).select("id", "embedding", "list")

    def near(batches):
        query_ids, q, bits = sent.value
        best = Nearest(query_ids, q, k, digits)
        for b in batches:
            for x, part in b.groupby("list"):
                mine = np.flatnonzero(bits[:, x >> 3] & (128 >> (x & 7)))
                best.add(part.id.to_numpy(), _matrix(part.embedding), mine)
        yield best.frame()

    return rows.mapInPandas(near, "query_id long, id long, distance double")


def recall_by_probes(index: Index, queries: DataFrame, exact: DataFrame) -> DataFrame:
    """(probes, recall): the share of the true neighbours in ``exact`` (query_id, id) that a search with so many probes would read.

    One pass: a neighbour is found from the number of probes on at which its list's turn comes. Of a query's lists only those that hold one of
    its neighbours become numbers."""
    held = exact.select("query_id", "id").join(index.vectors.select("id", "list"), "id").groupBy("query_id").agg(F.collect_list("list").alias("lists"))
    asked = queries.where("embedding is not null").select("query_id", "embedding").dropDuplicates(["query_id"]).join(held, "query_id")
    sent = index.spark.sparkContext.broadcast(index.centroids)

    def turns(batches):
        for b in _tiles(batches, len(sent.value)):
            turn = np.argsort(_ranked_lists(sent.value, b.embedding), axis=1)  # list -> its place
            yield pd.DataFrame({"probes": np.concatenate([t[x] for t, x in zip(turn, b.lists)]) + 1})

    at = asked.select("embedding", "lists").mapInPandas(turns, "probes long").groupBy("probes").count()
    total = Window.orderBy("probes").rowsBetween(Window.unboundedPreceding, 0)  # a row for each number of probes: LISTS at most
    return at.select("probes", (F.sum("count").over(total) / F.sum("count").over(Window.partitionBy())).alias("recall"))


def probes_for(index: Index, queries: DataFrame, exact: DataFrame, target: float) -> int:
    """The fewest probes with a recall of ``target`` on the given queries and their true neighbours."""
    row = recall_by_probes(index, queries, exact).where(F.col("recall") >= target).agg(F.min("probes")).first()
    return row[0] or len(index.centroids)
