"""Steps of the daily run over fetched articles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls, vectors
from ..shared import stored
from . import state

# The scoring rules.
THRESHOLD = 76
BONUS_SOURCE, BONUS, BEST = "Ben's Bites", 10, 100
TRUST = {"Hacker News": "high", "AI News": "high"}
OWN_CONTENT = ("aiNews", "rss")
SNIPPET, PROMPT_CONTENT = 200, 1500
BATCH = 5


def prompt_input(df: DataFrame) -> DataFrame:
    trust = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])
    return df.select(
        "url", "title", "source", F.when(F.length("content") > 0, F.substring("content", 1, SNIPPET)).alias("snippet"), F.try_element_at(trust, F.col("source")).alias("trust")
    )


def with_scores(articles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scores by URL, the last verdict of a URL (``pos``) and 0 where there is none; the favoured source gets its bonus."""
    last = state.last_wins(verdicts, "url", "pos").select("url", F.col("score").alias("verdict"))
    score = F.coalesce("verdict", F.lit(0))
    score = F.when(F.col("source") == BONUS_SOURCE, F.least(score + BONUS, F.lit(BEST))).otherwise(score)
    return articles.join(last, "url", "left").withColumn("score", score).drop("verdict")


def passing(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("score") >= THRESHOLD)


def batches(df: DataFrame, order: str, size: int = BATCH, by: str | None = None) -> DataFrame:
    """Batch numbers of ``size`` rows by position (``order`` is unique), within ``by`` if given."""
    rows = state.numbered(df, order, by, "pos")
    return rows.withColumn("batch", F.floor((F.col("pos") - 1) / size).cast("long"))


def ranked(scored: DataFrame, pos: str = "pos") -> DataFrame:
    """By score, best first; rows of one score in order of arrival."""
    return scored.orderBy(F.col("score").desc(), pos)


def known_story_inputs(articles: DataFrame) -> DataFrame:
    """What the comparison of stories is given of known articles; a missing address is written out as None."""
    return articles.select(F.coalesce("url", F.lit("None")).alias("url"), "title", "source")


def fill_content(articles: DataFrame, fetched: DataFrame) -> DataFrame:
    """Own content for feeds that carry it, else the fetched text by URL, else ''."""
    f = fetched.select("url", F.col("content").alias("fetched"))
    full = F.when(F.col("source_type").isin(*OWN_CONTENT), F.col("content")).otherwise(F.col("fetched"))
    return articles.join(f, "url", "left").withColumn("full_content", F.coalesce(full, F.lit(""))).drop("fetched")


def fill_snippets(articles: DataFrame, snippets: DataFrame) -> DataFrame:
    """Snippets by URL only where there is no content."""
    s = snippets.select("url", "snippet")
    content = F.coalesce(F.col("content"), F.lit(""))
    return articles.join(s, "url", "left").withColumn("content", F.when(content == "", F.coalesce("snippet", F.lit(""))).otherwise(content)).drop("snippet")


def dead_hosts(articles: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows whose URL has a host that isn't in ``hosts`` (host); a URL without a host is dead."""
    out = articles.withColumn("_host", urls.hostname(F.col("url"))).where("_host <> ''")
    return out.join(hosts.select(F.col("host").alias("_host")).distinct(), "_host", "left_anti").drop("_host")


def embedding_inputs(articles: DataFrame) -> DataFrame:
    return articles.select("id", text.embedding_text(F.col("title"), F.col("summary")).alias("text"))


#: Groups of vectors at most.
CENTRES = 1024


def near_vectors(vecs: DataFrame, least: float, rows: int = 4096) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of vectors (id, embedding) with a cosine of ``least`` or more, all of them.

    Up to ``rows`` vectors are one block in one task. More are grouped round one centre for each ``rows`` of them, and a group's radius is the
    widest angle to its centre: two groups meet only if the angle between their centres less both radii is within the angle that
    ``least`` allows, which loses no pair. Where most groups meet anyway, vectors are dealt into blocks without regard to groups. A pair of
    blocks is a task of bounded size that multiplies two matrices and returns only pairs that pass; a vector is copied
    once for each block that its own meets, ceil(n / rows) + groups at most. Work is quadratic where nothing can be ruled out;
    :func:`similar_vectors` is the near-linear way for high similarities.
    """
    unit = stored(vecs.where(vectors.norm(F.col("embedding")) > 0).select("id", vectors.normalise(F.col("embedding")).alias("v")), "unit-vectors")
    out = "a long, b long, similarity double"
    n = unit.count()
    groups = max(1, -(-n // rows))
    meets, placed = [(0, 0, groups, groups)], unit.withColumn("centre", F.lit(0))
    if groups > 1:
        chosen = unit.orderBy(F.xxhash64("id"), "id").limit(min(groups, CENTRES)).collect()
        centres = np.array([r.v for r in chosen], float)

        def place(batches):
            for b in batches:
                if len(b):
                    s = np.clip(np.stack(b.v.to_numpy()) @ centres.T, -1, 1)
                    yield pd.DataFrame({"id": b.id, "v": b.v, "centre": s.argmax(1).astype("int32"), "angle": np.arccos(s.max(1))})

        near = unit.mapInPandas(place, "id long, v array<double>, centre int, angle double")
        found = near.groupBy("centre").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row per centre
        radius, blocks = {g.centre: g.radius for g in found}, {g.centre: -(-g.n // rows) for g in found}
        most = np.arccos(np.clip(least, -1, 1)) + 1e-6
        between = np.arccos(np.clip(centres @ centres.T, -1, 1))
        pairs = [(x, y) for x in radius for y in radius if between[x, y] - radius[x] - radius[y] <= most]
        if 2 * len(pairs) <= len(radius) ** 2:
            meets, placed = [(int(x), int(y), int(blocks[x]), int(blocks[y])) for x, y in pairs], near.drop("angle")
    meeting = vecs.sparkSession.createDataFrame(meets, "centre int, other int, n int, m int")
    # A vector goes to each pair of its block and a block of a group that its own may meet.
    dealt = placed.join(F.broadcast(meeting), "centre").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    mine, theirs = F.struct(F.col("centre").alias("c"), F.col("block").alias("k")), F.struct(F.col("other").alias("c"), F.col("other_block").alias("k"))
    dealt = dealt.select("id", "v", F.least(mine, theirs).alias("i"), F.greatest(mine, theirs).alias("j"), (mine <= theirs).alias("left"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        same = bool(pdf.same.iloc[0])
        left, right = (pdf, pdf) if same else (pdf[pdf.left], pdf[~pdf.left])
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        s = np.stack(left.v.to_numpy()) @ np.stack(right.v.to_numpy()).T
        x, y = np.nonzero(s >= least)
        a, b = left.id.to_numpy()[x], right.id.to_numpy()[y]
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s[x, y]})
        return out[(a < b) if same else (a != b)]

    return dealt.withColumn("same", F.col("i") == F.col("j")).groupBy("i", "j").applyInPandas(compare, out)


def plane_recall(similarity: float, planes: int, tables: int) -> float:
    """The probability that two vectors of a similarity share one of ``tables`` signatures of ``planes`` random hyperplanes."""
    return 1 - (1 - (1 - np.arccos(np.clip(similarity, -1, 1)) / np.pi) ** planes) ** tables


def similar_vectors(vecs: DataFrame, least: float, planes: int = 12, tables: int = 24, rows: int = 2048, seed: int = 7) -> DataFrame:
    """Pairs (a, b, similarity), a < b, with a cosine of ``least`` or more that agree in a signature: candidates by random hyperplanes, each
    confirmed exactly. A pair is found with :func:`plane_recall`'s probability or a greater one (0.98 at 0.9 with the default values).

    A vector is copied ``tables`` times, and in a crowded bucket, which is cut into blocks of some ``rows`` vectors, once more for each of its
    blocks; a pair of blocks is a task. Pairs that share several signatures are returned once."""
    unit = stored(vecs.where(vectors.norm(F.col("embedding")) > 0).select("id", vectors.normalise(F.col("embedding")).alias("v")), "unit-vectors")
    first = unit.first()
    out = "a long, b long, similarity double"
    if first is None:
        return vecs.sparkSession.createDataFrame([], out)
    normals = np.random.default_rng(seed).normal(size=(len(first.v), tables * planes))

    def sign(batches):
        bit = 1 << np.arange(planes, dtype=np.int64)
        for b in batches:
            if len(b):
                on = (np.stack(b.v.to_numpy()) @ normals >= 0).reshape(len(b), tables, planes)
                yield pd.DataFrame({"id": b.id, "v": b.v, "signatures": list((on * bit).sum(2))})

    signed = unit.mapInPandas(sign, "id long, v array<double>, signatures array<long>")
    entries = signed.select("id", "v", F.posexplode("signatures").alias("t", "s"))
    crowded = entries.groupBy("t", "s").count().where("count > 1").select("t", "s", F.ceil(F.col("count") / rows).cast("int").alias("n"))
    dealt = entries.join(crowded, ["t", "s"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("t", "s", "id", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf.i.iloc[0], pdf.j.iloc[0]
        left, right = (pdf, pdf) if i == j else (pdf[pdf.block == i], pdf[pdf.block == j])
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        s = np.stack(left.v.to_numpy()) @ np.stack(right.v.to_numpy()).T
        x, y = np.nonzero(s >= least)
        a, b = left.id.to_numpy()[x], right.id.to_numpy()[y]
        found = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s[x, y]})
        return found[(a < b) if i == j else (a != b)]

    return dealt.groupBy("t", "s", "i", "j").applyInPandas(compare, out).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


#: New and known vectors that are multiplied at once (4 MB).
TILE = 512, 1024


def resembled(q: np.ndarray, found: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """``found``, with the rows of ``q`` marked that a row of ``x`` resembles; rows that were found before aren't compared again."""
    for j in range(0, len(x), TILE[1]):
        left = np.flatnonzero(~found)
        for i in range(0, len(left), TILE[0]):
            at = left[i : i + TILE[0]]
            found[at] = (q[at] @ x[j : j + TILE[1]].T >= least).any(1)
    return found


def story_hits(new: DataFrame, known: DataFrame, least: float, rows: int = 16_384) -> DataFrame:
    """id: the new rows (id, embedding), stored ones, that a known row resembles. New rows are sent to every task in blocks of ``rows``, and a task
    returns an id once; known rows aren't shuffled, and similarities are made in tiles of fixed size."""
    unit = lambda v: v.where(vectors.norm(F.col("embedding")) > 0).select("id", vectors.normalise(F.col("embedding")).alias("v"))
    mine, theirs = unit(new), unit(known)
    blocks = max(1, -(-new.count() // rows))
    found = None
    for i in range(blocks):  # a day's new rows are one block or a few
        block = mine.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # some ``rows`` rows
        ids, q = np.array([r.id for r in block], np.int64), np.array([r.v for r in block], float)
        sent = new.sparkSession.sparkContext.broadcast((ids, q))

        def near(batches, sent=sent):
            ids, q = sent.value
            hit = np.zeros(len(ids), bool)
            for b in batches:
                if len(ids) and len(b):
                    hit = resembled(q, hit, np.stack(b.v.to_numpy()), least)
            yield pd.DataFrame({"id": ids[hit]})

        now = theirs.mapInPandas(near, "id long")
        found = now if found is None else found.unionByName(now)
    return found.distinct()


def story_pairs(new: DataFrame, known: DataFrame, least: float, rows: int = 4096) -> DataFrame:
    """id, known: new rows (id, embedding), stored ones, with the known rows that they resemble: candidates for a model to judge. Blocks of new
    rows meet blocks of known rows, each pair of blocks in a task of bounded size that returns only the pairs that pass."""
    n, k = (max(1, -(-v.count() // rows)) for v in (new, known))

    def unit(v: DataFrame, side: int, i, j) -> DataFrame:
        return v.where(vectors.norm(F.col("embedding")) > 0).select("id", vectors.normalise(F.col("embedding")).alias("v"), F.lit(side).alias("side"), i.alias("i")).select("*", j.alias("j"))

    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = unit(new, 0, block(n), every(k)).unionByName(unit(known, 1, every(n), block(k)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "known": []})
        x, y = np.nonzero(np.stack(left.v.to_numpy()) @ np.stack(right.v.to_numpy()).T >= least)
        return pd.DataFrame({"id": left.id.to_numpy()[x], "known": right.id.to_numpy()[y]})

    return dealt.groupBy("i", "j").applyInPandas(compare, "id long, known long")


def without_stories(new: DataFrame, known: DataFrame, least: float, rows: int = 16_384) -> DataFrame:
    """New rows (id, embedding) that no known row resembles."""
    return new.join(story_hits(new, known, least, rows), "id", "left_anti")


def prompt_lines(df: DataFrame, by: str, order: str, line) -> DataFrame:
    """A numbered list per group, in order."""
    pos = F.row_number().over(Window.partitionBy(by).orderBy(order))
    rows = df.select(by, pos.alias("pos"), line.alias("line"))
    numbered = F.struct("pos", F.concat(F.col("pos").cast("string"), F.lit(". "), F.col("line")).alias("line"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(numbered)), lambda x: x["line"]), "\n").alias("prompt"))
