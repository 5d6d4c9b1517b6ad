"""Mixing of sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash of their id and queued up to ``repeats`` times. An entry's virtual finish time
is the source's words up to and including it, over the source's target. Entries are sorted by finish time over all sources
and the queue is cut where the words reach the budget, which is the words of all documents.

Targets: sources in code point order, null last, get the weights in turn and share the budget by them; a target stops at
``repeats`` times its source's words and the excess goes to the others by weight until none is above.

The queue is sorted over all sources by range partitions. Running sums take two levels: a partition's sums are added up first (a row
per partition), then rows within a partition; so no task holds a source or the whole queue, and the sum of whole partitions tells
which one holds the cut. A source's entries enter in order, so the cut is one (repeat, key) for each source, and documents meet it
in a join by source.

Rules for odd input: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own; rows
that repeat a doc_id within a source share one place in the queue and are taken together; with no words at all every target is
0. Only ``doc_id``, ``text`` and ``source`` are read; ``mixed`` passes other columns through and writes its own two over any of their
names.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, joined, ranged, stored

#: Rows that one task sorts, about 100 bytes each.
IN_TASK = 1_000_000
#: Sources whose table is broadcast; of more, the join deals a large source out over tasks.
FEW_SOURCES = 10_000


def _key() -> Column:
    """Place in the shuffled order: the hash of the id and, for the unlikely tie, the id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.concat(F.md5(name.cast("binary")), F.lit(":"), name)


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def _source() -> Column:
    """The source as text that sorts in code point order with null last, and is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))


def _ranged(df: DataFrame, rows: int, order: list[str], name: str) -> DataFrame:
    """``df`` range-sorted by ``order`` over partitions of about IN_TASK rows at most, stored with the partition's number ``part``."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // IN_TASK))
    return ranged(df, parts, order, "part", name)


def _by_source(left: DataFrame, table: DataFrame, n_sources: int, spread: list[str]) -> DataFrame:
    return left.join(F.broadcast(table), "of") if n_sources <= FEW_SOURCES else joined(left, table, "of", spread)


def _ranks(per_source: DataFrame, n: int) -> DataFrame:
    """``per_source`` with ``rank``, from 0, by source."""
    placed = _ranged(per_source, n, ["of"], "mix-names")
    counts = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per partition
    before = [(part, upto - n) for (part, n), upto in zip(counts, accumulate(n for _, n in counts))]
    offsets = per_source.sparkSession.createDataFrame(before, "part int, before long")
    number = F.row_number().over(Window.partitionBy("part").orderBy("of"))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + number - 1).drop("part", "before")


def targets(per_source: DataFrame, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, int, int]:
    """of, source_size, n_rows, target; the budget; and the number of sources."""
    n_sources = per_source.count()
    rank = F.col("rank") % len(weights)
    w = F.get(F.array(*[F.lit(x) for x in weights]), rank.cast("int"))
    ranked = stored(_ranks(per_source, n_sources).withColumn("weight", w).drop("rank"), "mix-sources")
    most = F.col("source_size") * repeats
    level = total = None
    while True:
        above = F.lit(False) if level is None else most < F.lit(level) * F.col("weight")
        r = ranked.agg(
            F.sum("source_size").alias("n"), F.sum(F.when(above, most).otherwise(0)).alias("capped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w")
        ).first()
        total = r.n or 0
        new = (total - r.capped) / r.w if r.w else (level or 0.0)
        if new == level:
            break
        level = new
    target = F.least(most.cast("double"), F.lit(float(level)) * F.col("weight"))
    return ranked.select("of", "source_size", "n_rows", target.alias("target")), total, n_sources


def _cut(queue: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """of, last_repeat, last_key of the entries whose running total in ``order`` stays within ``budget``. ``queue`` is ranged."""
    before, cut = 0, None
    for part, words in sorted((r.part, r.words) for r in queue.groupBy("part").agg(F.sum("words").alias("words")).collect()):  # a row per partition
        if before + words > budget:
            cut = part
            break
        before += words
    taken = queue.select("of", "repeat", "key")
    if cut is not None:
        whole = queue.where(F.col("part") < cut)
        running = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        edge = queue.where(F.col("part") == cut).withColumn("total", running).where(F.col("total") <= budget - before)
        taken = whole.select("of", "repeat", "key").unionByName(edge.select("of", "repeat", "key"))
    last = F.max(F.struct("repeat", "key"))
    return taken.groupBy("of").agg(last.alias("last")).select("of", F.col("last")["repeat"].alias("last_repeat"), F.col("last")["key"].alias("last_key"))


def _plan(docs: DataFrame, weights: tuple[int, ...], repeats: int) -> tuple[DataFrame, DataFrame, int]:
    """Slim table of the documents (doc_id, of, size, key), the table of sources with target and cut, and their number."""
    slim = stored(docs.select("doc_id", _source().alias("of"), _size().alias("size"), _key().alias("key")), "mix-slim")
    per_source = slim.groupBy("of").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    table, budget, n_sources = targets(per_source, weights, repeats)
    rows = table.agg(F.sum("n_rows")).first()[0] or 0

    places = slim.where("size > 0").groupBy("of", "key").agg(F.sum("size").alias("words"))
    placed = _ranged(places, rows, ["of", "key"], "mix-places")
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition and source
    sums = placed.groupBy("part", "of").agg(F.sum("words").alias("n"))
    offsets = sums.select("part", "of", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part", "of").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.withColumn("upto", F.sum("words").over(within)).join(offsets, ["part", "of"])
    entries = _by_source(upto.drop("part"), table, n_sources, ["key"]).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("repeat") * F.col("source_size") + F.col("offset") + F.col("upto")).cast("double") / F.col("target")
    order = ["finish", "of", "repeat", "key"]
    queue = _ranged(entries.select(finish.alias("finish"), "of", "repeat", "key", "words"), rows * repeats, order, "mix-queue")
    cut = stored(table.join(_cut(queue, budget, order), "of", "left").select("of", "source_size", "target", "last_repeat", "last_key"), "mix-cut")
    return slim, cut, n_sources


def _copies() -> Column:
    whole = F.col("last_repeat") + F.when(F.col("key") <= F.col("last_key"), 1).otherwise(0)
    return F.when(F.col("size") > 0, F.coalesce(whole, F.lit(0))).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) for every row of ``docs``."""
    slim, cut, n_sources = _plan(docs, weights, repeats)
    taken = (F.col("size") * _copies()).alias("taken")
    return _by_source(slim, cut, n_sources, ["key"]).select("doc_id", "size", "source_size", "target", taken)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, with mix_copies (how often) and mix_words (words taken) added."""
    _, cut, n_sources = _plan(docs, weights, repeats)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _source().alias("of"), _size().alias("size"), _key().alias("key"))
    found = _by_source(rows, cut, n_sources, ["key"]).withColumn("copies", _copies()).where("copies > 0")
    own = [c for c in docs.columns if c.lower() not in ("mix_copies", "mix_words")]
    return found.select(
        *[F.col("row")[c].alias(c) for c in own], F.col("copies").cast("int").alias("mix_copies"), (F.col("size") * F.col("copies")).alias("mix_words")
    )


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM d GROUP BY source),
r AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
             CAST(coalesce(sum(3 * source_size) OVER o, 0) AS BIGINT) AS capped,
             CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS rest,
             count(*) OVER o AS j
      FROM s WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(CAST(total - capped AS DOUBLE) / rest, j) AS level FROM r WHERE CAST(total - capped AS DOUBLE) / rest * w <= 3 * source_size),
t AS (SELECT source, source_size, total, least(CAST(3 * source_size AS DOUBLE), level * w) AS target FROM r, l),
p AS (SELECT source, k, CAST(sum(size) AS BIGINT) AS words FROM d WHERE size > 0 GROUP BY source, k),
u AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY k) AS BIGINT) AS upto FROM p),
q AS (SELECT u.source, e.e, k, words, total, CAST(e.e * source_size + upto AS DOUBLE) / target AS finish
      FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) e(e)),
c AS (SELECT source, k, count(*) AS copies FROM (
        SELECT source, k, total, sum(words) OVER (ORDER BY finish, source NULLS LAST, e, k ROWS UNBOUNDED PRECEDING) AS upto FROM q)
      WHERE upto <= total GROUP BY source, k)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(CASE WHEN size > 0 THEN size * coalesce(copies, 0) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.k = c.k
"""
