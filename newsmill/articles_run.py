"""The daily run: fetched rows against the article and scored-URL tables; returns the new snapshots.

Steps: unknown URLs, living hosts, semantic duplicates of recent articles, scoring and threshold, insertion with ids, titles, content,
summaries and categories and kinds, embeddings. Model steps use the rule stand-ins unless functions are given. Stories are compared by
the embeddings of their titles; a fetched URL that tells a story of a recent article is neither scored nor inserted.
"""

from __future__ import annotations

import functools
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import ledger, models
from .functions import dates, text, urls
from .operators import state, steps
from .shared import stored

STORY_DAYS, STORY_SIMILARITY, STORY_CANDIDATE = 14, 0.9, 0.4


def counted(df: DataFrame, name: str, counters: dict | None) -> DataFrame:
    """``df``, whose rows are counted into ``counters[name]`` by whatever action reads it first: ``counters[name].get["rows"]``."""
    if counters is None:
        return df
    counters[name] = Observation(name)
    return df.observe(counters[name], F.count(F.lit(1)).alias("rows"))


def run(
    fetched: DataFrame,
    articles: DataFrame,
    scored: DataFrame,
    as_of: datetime,
    dead: DataFrame | None = None,
    pages: DataFrame | None = None,
    score=models.rule_score,
    threshold: int = steps.THRESHOLD,
    embed=models.hashed_embedding,
    improve=None,
    summarize=models.rule_summary,
    categorize=models.rule_categories,
    kind_of=models.rule_kind,
    counters: dict | None = None,
    model: models.Model | None = None,
    book: ledger.Ledger | None = None,
    pause: float = 0.0,
) -> tuple[DataFrame, DataFrame]:
    """(new articles, scored URLs after the run). ``fetched`` has FETCHED's columns and pos; ``pages`` (url, content) are fetched texts;
    ``dead`` (host) are names that don't resolve. Model steps are functions of columns: ``score`` (title, content), ``improve`` (title:
    the title rewritten, null to leave it), ``summarize``, ``categorize`` and ``kind_of`` (content). A ``model`` takes the place of them all,
    called in chunks: when it fails to score, the run fails; a failed comparison of stories drops nothing; what fails later leaves the
    title as it was, or the summary empty. New articles get the ids after the
    largest one of ``articles``, in the order of their URLs. A second run on the results inserts nothing. With a ``book``, scores, titles and
    summaries are asked through this ledger: a run that failed is repeated without asking again for what was answered; failed calls
    are tried again, with ``pause`` seconds between calls of a task."""
    ask = functools.partial(ledger.asked, book=book, **({"pause": pause} if book else {}))
    rows = counted(state.fresh(counted(fetched, "fetched", counters), articles, scored), "unknown", counters)
    if dead is not None:
        rows = counted(steps.dead_hosts(rows, dead), "alive", counters)
    rows = without_known_stories(rows, recent(articles, as_of), model.embed if model else embed, model)
    if model:
        rows = stored(rows, "scoring")
        verdicts = ask(steps.prompt_input(rows), model.score, "url string, score int", steps.BATCH, step="score")
        judged = steps.with_scores(rows, verdicts.withColumn("pos", F.monotonically_increasing_id()))
    else:
        verdict = F.coalesce(score(F.col("title"), F.coalesce("content", F.lit(""))), F.lit(0))
        judged = rows.withColumn("score", F.when(F.col("source") == steps.BONUS_SOURCE, F.least(verdict + steps.BONUS, F.lit(steps.BEST))).otherwise(verdict))
    kept = counted(state.argmax(judged.where(F.col("score") >= threshold), "url", "score", "pos"), "kept", counters)
    made = kept.select(
        "url",
        text.sanitize(F.col("title")).alias("title"),
        "source",
        "source_type",
        dates.parse(F.col("published_date")).cast("timestamp").alias("published_at"),
        F.col("score").cast("int").alias("score"),
        F.coalesce("content", F.lit("")).alias("content"),
    )
    made = state.next_ids(articles, stored(made, "kept"), "id", "url")  # the insertion; what follows doesn't score again
    if pages is not None:
        made = steps.fill_content(made, pages)
    else:
        made = made.withColumn("full_content", F.when(F.col("source_type").isin(*steps.OWN_CONTENT), F.col("content")).otherwise(F.lit("")))
    if model:
        fixes = ask(made.select("url", "title", "source"), model.improve_titles, "url string, title string", 1, "keep", step="title")
        better = state.first_wins(fixes.withColumn("pos", F.monotonically_increasing_id()), "url", "pos").select("url", F.col("title").alias("better"))
        made = made.join(better, "url", "left")
    else:
        made = made.withColumn("better", improve(F.col("title")) if improve else F.lit(None).cast("string"))
    made = made.withColumn("title", text.accept_title(F.coalesce("better", F.lit("")), F.col("title"), F.col("source"))).drop("better")
    full = F.col("full_content")
    prompt = F.substring(full, 1, steps.PROMPT_CONTENT)
    has = full != ""
    if model:
        made, given = modelled(stored(made, "described"), prompt, has, model, ask)
    else:
        given = {
            "summary": F.when(has, summarize(prompt)),
            "categories": categorize(F.when(has, prompt).otherwise(F.col("title"))),
            "kind": F.when(has, kind_of(prompt)).otherwise(kind_of(F.col("title"))),
        }
    done = made.select(
        "id",
        "url",
        "title",
        "source",
        "source_type",
        "published_at",
        "score",
        text.sanitize(F.coalesce(given["summary"], F.lit(""))).alias("summary"),
        F.coalesce(text.lowered(given["categories"]), F.array().cast("array<string>")).alias("categories"),
        F.when(has, urls.resolve_kind(F.col("url"), given["kind"], full)).otherwise(F.coalesce(urls.kind_from_url(F.col("url")), F.lower(given["kind"]))).alias("kind"),
        F.when(has, full).otherwise(F.col("content")).alias("content"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
    )
    vecs = embedded(steps.embedding_inputs(done), model.embed if model else embed)
    return done.join(vecs, "id", "left"), state.upsert_keys(scored, rows, "url")


def modelled(made: DataFrame, prompt, has, model: models.Model, ask=ledger.asked) -> tuple[DataFrame, dict]:
    """``made`` with the model's answers, and the columns that hold them: articles with a text are summarised, the others get categories
    and a kind by their titles."""
    answer = "id long, summary string, categories array<string>, kind string"
    whole = ask(made.where(has).select("id", "title", prompt.alias("content")), model.summarize, answer, 1, "keep", step="summary", key="id")
    bare = made.where(~has)
    named = ask(bare.select("id", "title"), model.categorize, "id long, categories array<string>", 1, "keep", step="categories", key="id").select("id", "categories")
    kinds = ask(bare.select("id", "title", "url", F.lit(None).cast("string").alias("summary")), model.classify_kind, "id long, kind string", 1, "keep", step="kind", key="id").select("id", "kind")
    every = whole.select("id", "summary", "categories", "kind").unionByName(named.join(kinds, "id", "full"), allowMissingColumns=True)
    answers = every.toDF("id", "given_summary", "given_categories", "given_kind")
    return made.join(answers, "id", "left"), {c: F.col(f"given_{c}") for c in ("summary", "categories", "kind")}


def embedded(texts: DataFrame, embed) -> DataFrame:
    """(id, embedding) of (id, text), each id once."""
    return models.apply(texts.dropDuplicates(["id"]), embed, "id long, embedding array<float>", chunk=1000)


def without_known_stories(rows: DataFrame, known: DataFrame, embed, model: models.Model | None = None) -> DataFrame:
    """Rows without the URLs whose title resembles a title of ``known``; with a model, resemblance makes candidates and the model decides."""
    if known.isEmpty():
        return rows
    texts = lambda df: df.select(F.xxhash64("title").alias("id"), F.col("title").alias("text"))
    # Stored, so that a title is embedded once whatever reads its vector.
    new, old_ = stored(embedded(texts(rows), embed), "new-titles"), stored(embedded(texts(known), embed), "known-titles")
    tagged = rows.withColumn("_story", F.xxhash64("title"))
    if model is None:
        told = tagged.join(steps.story_hits(new, old_, STORY_SIMILARITY).withColumnRenamed("id", "_story"), "_story", "left_semi").select("url")
    else:
        old = steps.known_story_inputs(known).select(F.xxhash64("title").alias("known"), F.col("url").alias("known_url"), F.col("title").alias("known_title"))
        pairs = steps.story_pairs(new, old_, STORY_CANDIDATE)
        asked = tagged.join(pairs.withColumnRenamed("id", "_story"), "_story").join(old, "known").select("url", "title", "known_url", "known_title")
        told = models.apply(asked, model.same_story, "url string, known_url string", 50, "keep").where("error is null").select("url")
    return tagged.drop("_story").join(told.distinct(), "url", "left_anti")


def recent(articles: DataFrame, as_of: datetime) -> DataFrame:
    """The side against which new stories are compared: dated articles of the last days."""
    return articles.where(F.col("published_at") >= F.lit(as_of - timedelta(days=STORY_DAYS)))
