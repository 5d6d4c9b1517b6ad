"""Named article queries and the SQL each is checked against."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import articles_run
from ..functions import dates, markup, text, urls, vectors
from ..operators import discover, feed, state, steps
from . import articles as view
from .articles import AS_OF, SQL, articles, read

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

PUBLIC = "id, title, source, source_type, url, published_at, score, summary, categories, kind, created_at"
SINCE = "published_at >= TIMESTAMP '2026-05-30 00:00:00'"
HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '^www\.', '')"


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _feed_sql(where: str = "", order: str = "score DESC, id", limit: int = 20) -> str:
    return f"WITH {SQL} SELECT {PUBLIC} FROM articles WHERE score IS NOT NULL AND {SINCE}{where} ORDER BY {order} LIMIT {limit}"


# --- feed -----------------------------------------------------------------------------------


@_query(_feed_sql())
def feed_default(spark, d):
    return feed.feed(articles(spark, d), AS_OF)


@_query(_feed_sql(order="published_at DESC, id"))
def feed_by_date(spark, d):
    return feed.feed(articles(spark, d), AS_OF, sort="published_at")


@_query(_feed_sql(" AND score >= 8"))
def feed_min_score(spark, d):
    return feed.feed(articles(spark, d), AS_OF, min_score=8)


@_query(_feed_sql(" AND list_contains(categories, 'research')"))
def feed_category(spark, d):
    return feed.feed(articles(spark, d), AS_OF, category="research")


@_query(_feed_sql(" AND kind = 'paper'"))
def feed_kind(spark, d):
    return feed.feed(articles(spark, d), AS_OF, kind="paper")


@_query(f"WITH {SQL} SELECT {PUBLIC} FROM articles WHERE score IS NOT NULL AND published_at >= TIMESTAMP '2026-06-09 00:00:00' AND score >= 5 AND list_contains(categories, 'dev') AND kind = 'blog' ORDER BY published_at DESC, id LIMIT 50")
def feed_all_filters(spark, d):
    return feed.feed(articles(spark, d), AS_OF, limit=50, sort="published_at", since="2026-06-09T00:00:00Z", min_score=5, category="dev", kind="blog")


@_query(f"WITH {SQL} SELECT count(*) AS count FROM articles WHERE score IS NOT NULL AND {SINCE} AND list_contains(categories, 'models')")
def feed_count(spark, d):
    return feed.feed_count(articles(spark, d, url=False), AS_OF, category="models")


# --- search and statistics ------------------------------------------------------------------

_DIST = "round(1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), {b}), 6)"


@_query(f"WITH {SQL} SELECT id, title, {_DIST.format(a='embedding', b='list_transform(range(64), lambda i: 0.05::DOUBLE)')} AS distance FROM articles WHERE score IS NOT NULL AND embedding IS NOT NULL ORDER BY distance, id LIMIT 20")
def search_topk(spark, d):
    found = feed.search(articles(spark, d, embedding=True), [0.05] * 64)
    return found.select("id", "title", F.round("distance", 6).alias("distance"))


@_query(f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, vec_id AS id, {_DIST.format(a='embedding', b='query')} AS distance FROM embeddings, q)
SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 10""")
def search_topk_batch(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    # Ranked on rounded distances, as the two engines differ in the last digits.
    found = feed.search_batch(e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, digits=6)
    return found.withColumn("rank", F.col("rank").cast("long"))


def _index_of(spark, d):
    from ..operators import vector_index
    from ..shared import new_folder

    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector_index.build_index(e, new_folder(spark, "vector-index")), e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id")


@_query(f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, vec_id AS id, {_DIST.format(a='embedding', b='query')} AS distance FROM embeddings, q)
SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 10""")
def index_search_exact(spark, d):
    """The stored index asked with all of its lists, which is the exact answer; half of the vectors are added after it was built."""
    from ..operators import vector_index
    from ..shared import new_folder

    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = vector_index.build_index(e.where("id % 2 = 0"), new_folder(spark, "vector-index"))
    vector_index.add(index, e.where("id % 2 <> 0"), "second")
    found = vector_index.search(index, e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, len(index.centroids), digits=6)
    return found.withColumn("rank", F.col("rank").cast("long"))


@_query()
def index_recall(spark, d):
    """The stored index asked with the fewest probes that reach a recall of 0.95 on every hundredth vector: per query its neighbours, and how many of
    the ten true ones are among them."""
    from ..operators import vector_index
    from ..shared import stored

    index, e, queries = _index_of(spark, d)
    exact = stored(feed.search_batch(e, queries, 10), "true-neighbours")
    probes = vector_index.probes_for(index, queries.where("query_id % 100 = 0"), exact.where("query_id % 100 = 0"), 0.95)
    found = vector_index.search(index, queries, 10, probes).select("query_id", "id", F.lit(True).alias("found"))
    both = exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("found").alias("hits"), F.count("*").alias("true_neighbours"))
    return both.withColumns({"probes": F.lit(probes), "lists": F.lit(len(index.centroids))})


@_query(f"WITH {SQL} SELECT count(*) AS total, strftime(max(created_at), '%Y-%m-%dT%H:%M:%S.%f') AS last_updated FROM articles")
def article_stats(spark, d):
    return feed.stats(articles(spark, d, url=False))


# --- known URLs, scores, argmax -----------------------------------------------------------------


@_query(f"WITH {SQL}, known AS (SELECT url FROM articles WHERE score >= 95 UNION SELECT url FROM pages WHERE page_id < 20) SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM known WHERE url IS NOT NULL)")
def fresh_urls(spark, d):
    pages = read(spark, d, "pages")
    return state.fresh(pages.select("page_id", "url"), articles(spark, d).where("score >= 95"), pages.where("page_id < 20"))


_FRESH = f"WITH {SQL}, known AS (SELECT url FROM articles WHERE score >= 95 UNION SELECT url FROM pages WHERE page_id < 20) SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM known WHERE url IS NOT NULL)"


def _known(spark, d):
    """Two days of known addresses."""
    return articles(spark, d).where("score >= 95").select("url"), read(spark, d, "pages").where("page_id < 20").select("url")


@_query(_FRESH)
def fresh_urls_bucketed(spark, d):
    """fresh_urls by a bucketed history, which isn't shuffled."""
    from ..operators import history
    from ..shared import new_folder

    where = new_folder(spark, "history")
    known = history.UrlHistory(spark, "known_" + where.rsplit("-", 1)[1], where, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for day, keys in zip(("2026-06-27", "2026-06-28"), _known(spark, d)):
        known.add(keys, day)
    return known.fresh(read(spark, d, "pages").select("page_id", "url"))


@_query(_FRESH)
def fresh_urls_filtered(spark, d):
    """fresh_urls by the merged filters of two days; only what these don't clear is joined."""
    from ..operators import history
    from ..shared import new_folder

    where = new_folder(spark, "url-filter")
    days = _known(spark, d)
    for day, keys in zip(("2026-06-27", "2026-06-28"), days):
        history.store_day(history.filter_of(keys, "url"), where, day)
    known = history.merged(spark.read.parquet(where))
    return history.fresh_by_filter(read(spark, d, "pages").select("page_id", "url"), "url", known, days[0].unionByName(days[1]))


def _verdicts(spark, d):
    return read(spark, d, "labels").select(F.concat(F.lit("u"), F.col("doc_id")).alias("url"), (F.col("quality") * 60 + F.col("doc_id") % 41).cast("int").alias("score"), F.col("doc_id").alias("pos"))


def _to_score(spark, d):
    source = F.when(F.col("source") == "src1", F.lit("Ben's Bites")).otherwise(F.col("source"))
    return read(spark, d, "documents").select(F.concat(F.lit("u"), F.col("doc_id")).alias("url"), source.alias("source"))


_SCORED = """s AS (SELECT 'u' || d.doc_id AS url, CASE WHEN source = 'src1' THEN 'Ben''s Bites' ELSE source END AS source,
  CASE WHEN source = 'src1' THEN least(coalesce(quality * 60 + l.doc_id % 41, 0) + 10, 100) ELSE coalesce(quality * 60 + l.doc_id % 41, 0) END AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@_query(f"WITH {_SCORED} SELECT url, source, CAST(score AS INTEGER) AS score FROM s")
def scored_join(spark, d):
    return steps.with_scores(_to_score(spark, d), _verdicts(spark, d)).select("url", "source", F.col("score").cast("int").alias("score"))


@_query(f"WITH {_SCORED} SELECT url, CAST(score AS INTEGER) AS score FROM s WHERE score >= 76")
def score_threshold(spark, d):
    return steps.passing(steps.with_scores(_to_score(spark, d), _verdicts(spark, d))).select("url", F.col("score").cast("int").alias("score"))


@_query(f"WITH {_SCORED} SELECT source, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, CAST(max(score) AS INTEGER) AS best FROM s GROUP BY source")
def source_bonus(spark, d):
    s = steps.with_scores(_to_score(spark, d), _verdicts(spark, d))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total"), F.max("score").cast("int").alias("best"))


def _dedup_sql(order: str) -> str:
    return f"WITH {SQL} SELECT url, id, score FROM articles WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY {order}) = 1"


def _positions(spark, d):
    return articles(spark, d).where("score IS NOT NULL").select("url", "id", "score", F.col("id").alias("pos"))


@_query(_dedup_sql("score DESC, id"))
def dedup_argmax(spark, d):
    return state.argmax(_positions(spark, d), "url", "score", "pos").select("url", "id", "score")


@_query(_dedup_sql("id"))
def dedup_first(spark, d):
    return state.first_wins(_positions(spark, d), "url", "pos").select("url", "id", "score")


@_query(_dedup_sql("id DESC"))
def dedup_last(spark, d):
    return state.last_wins(_positions(spark, d), "url", "pos").select("url", "id", "score")


@_query("SELECT md5(text) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_exact_text(spark, d):
    return read(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# --- fills, joins by id -----------------------------------------------------------------------


@_query(f"""WITH {SQL}, f AS (SELECT url, html FROM pages WHERE page_id % 2 = 0)
SELECT id, md5(CASE WHEN source_type IN ('aiNews', 'rss') THEN coalesce(content, '') ELSE coalesce(html, '') END) AS full_content FROM articles LEFT JOIN f ON articles.url = f.url""")
def content_fill(spark, d):
    fetched = read(spark, d, "pages").where("page_id % 2 = 0").select("url", F.col("html").alias("content"))
    return steps.fill_content(articles(spark, d), fetched).select("id", F.md5(F.col("full_content").cast("binary")).alias("full_content"))


@_query("SELECT doc_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def embedding_join(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return read(spark, d, "documents").join(e, "doc_id", "left").select("doc_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@_query("SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS owner_name FROM orders")
def owner_backfill(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner_name"))
    return read(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", "owner_name")


@_query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS o_orderdate FROM orders) ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 100 OFFSET 10")
def page_items(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    return feed.page(o, "o_orderdate", "o_orderkey", 10, 100)


@_query("SELECT c_custkey, c_name, c_acctbal, c_custkey = 7 AS is_current FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25")
def page_users(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") == 7).alias("is_current"))
    return feed.page(c, "c_acctbal", "c_custkey", 0, 25)


@_query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS owners FROM orders WHERE o_custkey = 7")
def owned_count(spark, d):
    return feed.owned(read(spark, d, "orders"), "o_custkey", 7).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("owners"))


# --- upserts and deletes ------------------------------------------------------------------------


@_query("WITH o AS (SELECT DISTINCT 'u' || user_id AS url FROM events WHERE event_type = 'click') SELECT url FROM o UNION SELECT 'u' || user_id FROM events WHERE event_type <> 'click' AND user_id IS NOT NULL")
def upsert_scored(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), "event_type")
    return state.upsert_keys(e.where("event_type = 'click'").select("url").distinct(), e.where("event_type <> 'click'"), "url")


@_query("""WITH e AS (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'user' || user_id ELSE 'user' || user_id || '@example.com' END AS email FROM events),
o AS (SELECT email, max(event_id) AS first FROM e WHERE event_type = 'click' GROUP BY email),
n AS (SELECT email, event_type, event_id FROM e WHERE event_type <> 'click' AND contains(email, '@') QUALIFY row_number() OVER (PARTITION BY email ORDER BY event_id DESC) = 1)
SELECT coalesce(o.email, n.email) AS email,
  CASE WHEN n.email IS NOT NULL THEN CASE WHEN event_type = 'view' THEN ['all'] ELSE [event_type] END ELSE ['old'] END AS categories,
  CASE WHEN o.email IS NOT NULL THEN TIMESTAMP '2026-01-01 00:00:00' ELSE TIMESTAMP '2026-06-29 00:00:00' END AS created_at,
  CASE WHEN n.email IS NOT NULL THEN TIMESTAMP '2026-06-29 00:00:00' ELSE TIMESTAMP '2026-01-01 00:00:00' END AS updated_at
FROM o FULL JOIN n ON o.email = n.email""")
def upsert_subscribers(spark, d):
    email = F.concat(F.lit("user"), F.col("user_id"), F.when(F.col("user_id") % 7 == 0, "").otherwise("@example.com"))
    e = read(spark, d, "events").select(email.alias("email"), "event_type", F.col("event_id").alias("pos"))
    at = F.lit(datetime(2026, 1, 1)).cast("timestamp")
    none = F.lit(None).cast("string")
    old = e.where("event_type = 'click'").select("email").distinct()
    old = old.select("email", F.array(F.lit("old")).alias("categories"), none.alias("custom_category"), none.alias("utm_source"), at.alias("created_at"), at.alias("updated_at"))
    empty = F.array().cast("array<string>")
    new = e.where("event_type <> 'click'").select("email", F.when(F.col("event_type") == "view", empty).otherwise(F.array("event_type")).alias("categories"), none.alias("custom_category"), none.alias("utm_source"), "pos")
    out = state.upsert_subscribers(old, new, AS_OF)
    return out.select("email", "categories", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")])


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return state.cascade_delete(c, o, c.where("c_acctbal < 0"), "c_custkey", "o_custkey")[1]


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def partial_update(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    change = c.where("c_custkey % 3 = 0").select(
        "c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(True).alias("c_mktsegment_set"), F.lit(None).cast("double").alias("c_acctbal"), (F.col("c_custkey") % 6 == 0).alias("c_acctbal_set")
    )
    return state.update_set(c, change, "c_custkey", ["c_mktsegment", "c_acctbal"])


@_query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1)")
def key_conflicts(spark, d):
    return state.conflicts(read(spark, d, "customer"), "c_custkey", "c_nationkey").select("c_custkey")


@_query("SELECT page_id, (SELECT max(page_id) FROM pages) + row_number() OVER (ORDER BY url || ' ' || page_id) AS new_id FROM pages")
def next_ids(spark, d):
    p = read(spark, d, "pages")
    rows = p.select(F.col("page_id").alias("old"), F.concat_ws(" ", "url", "page_id").alias("name"))
    return state.next_ids(p, rows, "page_id", "name").select(F.col("old").alias("page_id"), F.col("page_id").alias("new_id"))


# --- scalar functions over the pages' URLs and texts -------------------------------------------------


@_query(f"SELECT page_id, {HOST} AS host FROM pages")
def host_of(spark, d):
    return read(spark, d, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"))


_NEW_HOST = "CASE page_id % 9 WHEN 0 THEN 'github.com' WHEN 1 THEN 'hf.co' WHEN 2 THEN 'arxiv.org' WHEN 3 THEN 'old.reddit.com' WHEN 4 THEN 'mobile.x.com' WHEN 5 THEN 'foo.github.io' WHEN 6 THEN 'blog.openai.com' WHEN 7 THEN 'x.com' ELSE 'netflix.com' END"


# Each page's own address, and the same address at a host that has a meaning.
_OWN_KIND = f"CASE WHEN {HOST} IN ('github.com', 'gitlab.com') THEN 'repo' WHEN {HOST} IN ('huggingface.co', 'hf.co') THEN 'model' WHEN {HOST} IN ('arxiv.org', 'ar5iv.labs.arxiv.org') THEN 'paper' END"


def _moved(spark, d):
    rows = read(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^([A-Za-z]+://)", 1).alias("scheme"), F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "").alias("rest"))
    return rows.select("page_id", "url", F.concat("scheme", F.expr(_NEW_HOST), "rest").alias("moved"))


def _class_sql(h: str) -> str:
    return (
        f"CASE WHEN {h} = 'github.com' OR {h} LIKE '%.github.io' THEN 'github' WHEN {h} IN ('huggingface.co', 'hf.co') THEN 'huggingface' "
        f"WHEN {h} IN ('arxiv.org', 'ar5iv.labs.arxiv.org') THEN 'arxiv' "
        rf"WHEN regexp_matches({h}, '(^|[^\p{{L}}\p{{N}}_])({urls.BLOG_WORDS})($|[^\p{{L}}\p{{N}}_])') OR {h} LIKE '%.ai' OR {h} LIKE '%.dev' OR contains({h}, 'substack.com') THEN 'blog' "
        f"WHEN {h} = 'reddit.com' OR {h} LIKE '%.reddit.com' THEN 'reddit' WHEN {h} IN ('x.com', 'twitter.com') THEN 'tweet' END"
    )


def _skip_sql(h: str) -> str:
    return f"({h} IN ('x.com', 'twitter.com') OR {h} LIKE '%.x.com' OR {h} LIKE '%.twitter.com')"


@_query(f"SELECT page_id, {_OWN_KIND} AS own, CASE page_id % 9 WHEN 0 THEN 'repo' WHEN 1 THEN 'model' WHEN 2 THEN 'paper' END AS moved FROM pages")
def kind_from_url(spark, d):
    return _moved(spark, d).select("page_id", urls.kind_from_url(F.col("url")).alias("own"), urls.kind_from_url(F.col("moved")).alias("moved"))


@_query(f"SELECT page_id, {_class_sql(HOST)} AS own, {_class_sql('h')} AS moved FROM (SELECT page_id, url, {_NEW_HOST} AS h FROM pages)")
def classify_host(spark, d):
    return _moved(spark, d).select("page_id", urls.classify_host(urls.host_of(F.col("url"))).alias("own"), urls.classify_host(urls.host_of(F.col("moved"))).alias("moved"))


@_query(f"SELECT page_id, {_skip_sql(HOST)} AS own, {_skip_sql('h')} AS moved FROM (SELECT page_id, url, {_NEW_HOST} AS h FROM pages)")
def skip_domain(spark, d):
    return _moved(spark, d).select("page_id", urls.skip_domain(F.col("url")).alias("own"), urls.skip_domain(F.col("moved")).alias("moved"))


@_query(r"SELECT page_id, regexp_replace(regexp_replace(url, '([?&])utm_[^&#]*&?', '\1', 'g'), '[?&]+(#|$)', '\1', 'g') AS url FROM pages")
def strip_utm(spark, d):
    return read(spark, d, "pages").select("page_id", urls.strip_utm(F.col("url")).alias("url"))


@_query(r"SELECT doc_id, md5(trim(regexp_replace(text, '^\s*(?:[Ss]how|[Aa]sk) HN:\s*', ''), ' ' || chr(10))) AS title FROM documents")
def clean_title(spark, d):
    c = F.concat(F.when(F.col("doc_id") % 2 == 0, "Show HN: ").otherwise("ask hn: "), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(text.clean_title(c).cast("binary")).alias("title"))


@_query("SELECT doc_id, md5(trim(text, ' ' || chr(10))) AS title FROM documents")
def strip_wrappers(spark, d):
    c = F.concat(F.lit('[HN] 1. "'), F.col("text"), F.lit('"'))
    return read(spark, d, "documents").select("doc_id", F.md5(text.strip_wrappers(c).cast("binary")).alias("title"))


@_query(r"""SELECT doc_id, md5(trim(regexp_replace('"a" - it''s -> ... - ' || text, ' {2,}', ' ', 'g'), ' ' || chr(10))) AS title FROM documents""")
def sanitize_text(spark, d):
    c = F.concat(F.lit("“a” – it’s → … ▪ 🚀 "), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(text.sanitize(c).cast("binary")).alias("title"))


_STRIPPED = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' ')"


@_query(f"SELECT page_id, md5({_STRIPPED}) AS text FROM pages")
def strip_tags(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(markup.strip_tags(F.col("html")).cast("binary")).alias("text"))


@_query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' ')) AS text FROM documents")
def whitespace_norm(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(text.whitespace_norm(F.col("text")).cast("binary")).alias("text"))


_LINK = """'<a[^>]+href="([^"]+)"[^>]*>([\\s\\S]*?)</a>'"""


@_query(f"SELECT page_id, len(regexp_extract_all(html, {_LINK})) AS n, array_to_string(regexp_extract_all(html, {_LINK}, 1), ' ') AS links FROM pages")
def collect_links(spark, d):
    links = markup.collect_links(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n"), F.array_join(F.transform(links, lambda x: x["url"]), " ").alias("links"))


@_query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://github.com/a/b' || page_id WHEN 1 THEN 'https://arxiv.org/abs/' || page_id
  ELSE coalesce(list_filter(regexp_extract_all(html, {_LINK}, 1), lambda x: x <> '')[1], CASE WHEN page_id % 4 = 2 THEN 'https://x.com/i/lists/1' ELSE '' END) END AS url,
  CASE page_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'arxiv' ELSE 'other' END AS kind
  FROM pages WHERE page_id % 4 <> 2 UNION ALL
  SELECT page_id, coalesce(regexp_extract_all(html, {_LINK}, 1)[1], '') AS url, 'other' AS kind FROM pages WHERE page_id % 4 = 2""")
def primary_link(spark, d):
    """The pages' links; in some a repository stands behind posts, in some a paper behind a thread, in some there is junk in front."""
    a = lambda u: F.concat(F.lit('<a href="'), u, F.lit('">t</a>'))
    i = F.col("page_id")
    html = (
        F.when(i % 4 == 0, F.concat("html", a(F.lit("https://x.com/p/1")), a(F.concat(F.lit("https://github.com/a/b"), i)), a(F.lit("https://arxiv.org/abs/1"))))
        .when(i % 4 == 1, F.concat("html", a(F.lit("https://old.reddit.com/r/x")), a(F.concat(F.lit("https://arxiv.org/abs/"), i))))
        .when(i % 4 == 2, F.concat(a(F.lit("https://x.com/i/lists/1")), F.col("html")))
        .otherwise(F.col("html"))
    )
    p = markup.pick_primary(markup.collect_links(html))
    return read(spark, d, "pages").select("page_id", p["url"].alias("url"), p["kind"].alias("kind"))


@_query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<li>([\s\S]*?)</li>', 1)[1:3], lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[\s\x{85}\p{Z}]+', ' ', 'g'), ' ')), ' ') AS bullets FROM pages""")
def first_bullets(spark, d):
    return read(spark, d, "pages").select("page_id", markup.bullets(F.col("html")).alias("bullets"))


@_query(r"SELECT page_id, md5(regexp_extract(html, '(?s)<h1[^>]*>[^<]*</h1>(.*)$', 1)) AS section FROM pages")
def section_slice(spark, d):
    named = F.regexp_replace("html", r"<h1[^>]*>[^<]*</h1>", "<h1 class=x> Head </h1>")
    return read(spark, d, "pages").select("page_id", F.md5(markup.slice_section(named, "Head").cast("binary")).alias("section"))


@_query(r"""WITH s AS (SELECT page_id, string_split(html, '<a ') AS parts FROM pages),
x AS (SELECT page_id, unnest(range(2, len(parts) + 1)) AS n, parts FROM s),
o AS (SELECT page_id, n - 1 AS n, 1 + length(array_to_string(parts[1:n - 1], '<a ')) AS start, length(array_to_string(parts, '<a ')) AS size FROM x)
SELECT page_id, CAST(n AS INTEGER) AS n, start, lead(start, 1, size + 1) OVER (PARTITION BY page_id ORDER BY n) AS stop FROM o""")
def lead_segments(spark, d):
    p = read(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("size"), F.posexplode(F.split("html", "(?=<a )", -1)).alias("n", "part"))
    before = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = p.withColumn("start", (F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + 1).cast("long")).where(F.col("part").startswith("<a "))
    w = Window.partitionBy("page_id").orderBy("start")
    return at.select("page_id", F.row_number().over(w).alias("n"), "start", F.coalesce(F.lead("start").over(w), F.col("size") + 1).alias("stop"))


@_query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch FROM documents")
def batch_ids(spark, d):
    return steps.batches(read(spark, d, "documents").select("doc_id", "source"), "doc_id", by="source").withColumn("pos", F.col("pos").cast("long"))


@_query("SELECT conv_id, md5(string_agg(pos || '. ' || line, chr(10) ORDER BY pos)) AS prompt FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role || ': ' || text AS line FROM conversations) GROUP BY conv_id")
def prompt_lines(spark, d):
    c = read(spark, d, "conversations")
    out = steps.prompt_lines(c, "conv_id", "turn", F.concat("role", F.lit(": "), "text"))
    return out.select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@_query("SELECT doc_id, CASE WHEN length(text) > 0 THEN md5(substring(text, 1, 200)) END AS snippet, CASE WHEN source = 'src1' THEN 'high' END AS trust FROM documents")
def prompt_inputs(spark, d):
    source = F.when(F.col("source") == "src1", "Hacker News").otherwise(F.col("source"))
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("url"), F.lit("t").alias("title"), source.alias("source"), F.col("text").alias("content"))
    return steps.prompt_input(rows).select(F.col("url").alias("doc_id"), F.md5(F.col("snippet").cast("binary")).alias("snippet"), "trust")


@_query(rf"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({text.KEYWORDS})($|[^\p{{L}}\p{{N}}_])')")
def keyword_filter(spark, d):
    return read(spark, d, "documents").where(text.keyword_match(F.col("text"))).select("doc_id")


@_query(r"SELECT doc_id FROM documents WHERE length(text) < 50 OR regexp_matches(text || ' Access  denied', '(?i)access\s+denied') AND doc_id % 3 = 0")
def blocker_filter(spark, d):
    c = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Access  denied"))).otherwise(F.col("text"))
    return read(spark, d, "documents").where(text.is_blocker(c) | (F.length("text") < 50)).select("doc_id")


@_query(f"WITH {SQL} SELECT id FROM articles WHERE published_at IS NULL OR published_at >= TIMESTAMP '2026-06-22 00:00:00'")
def window_filter(spark, d):
    return articles(spark, d, url=False).where(dates.within_window(F.col("published_at"), AS_OF)).select("id")


@_query("SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 + CASE o_orderkey % 5 WHEN 2 THEN 5 ELSE 0 END AS INTEGER)) AS at FROM orders")
def parse_dates(spark, d):
    """Mail dates with and without seconds, with zone names and full month names, and ISO dates."""
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    shown = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.date_format(at, "d MMMM yyyy HH:mm"), F.lit(" +0000")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.date_format(at, "EEEE, d MMM yyyy HH:mm:ss"), F.lit(" EST")))
        .otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return read(spark, d, "orders").select("o_orderkey", dates.parse(shown).cast("timestamp_ntz").alias("at"))


@_query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, d):
    from ..streaming.admission import windowed_counts

    return windowed_counts(read(spark, d, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("""WITH e AS (SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 7200000000, true) AS opens FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, d):
    """Sessions of each user, two hours apart."""
    from ..streaming.windows import session_counts

    at = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return session_counts(read(spark, d, "events"), "ts", "user_id", "2 hours").select("user_id", at("session_start"), at("session_end"), "n")


# --- dedup, extraction, the run ----------------------------------------------------------------------


@_query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS similarity FROM e x JOIN e y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.4""")
def semantic_dedup_cosine(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return steps.near_vectors(e, 0.4).withColumn("similarity", F.round("similarity", 6))


@_query(f"""WITH {SQL}, v AS (SELECT id, published_at, CAST(embedding AS DOUBLE[]) AS v FROM articles WHERE embedding IS NOT NULL),
known AS (SELECT * FROM v WHERE id % 3 <> 0 AND published_at >= TIMESTAMP '2026-06-15 00:00:00'), fresh AS (SELECT * FROM v WHERE id % 3 = 0)
SELECT id FROM fresh WHERE id NOT IN (SELECT f.id FROM fresh f JOIN known k ON list_cosine_similarity(f.v, k.v) >= 0.35)""")
def fresh_stories(spark, d):
    """The story step by fixed vectors: new articles that no article of the last 14 days resembles."""
    from ..shared import stored

    rows = articles(spark, d, url=False, embedding=True).where("embedding is not null").select("id", "published_at", "embedding")
    new = stored(rows.where("id % 3 = 0").select("id", "embedding"), "new-stories")
    known = stored(articles_run.recent(rows.where("id % 3 <> 0"), AS_OF).select("id", "embedding"), "known-stories")  # read once for each block of new ones
    return steps.without_stories(new, known, 0.35).select("id")


def _main_sql(limit: int | None = None) -> str:
    """The block scoring of markup.main_text step by step; walls that the tables may hold are those of text.BLOCKERS."""
    body = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
    for tag in markup.NO_TEXT:
        body = f"regexp_replace({body}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    inner = lambda tag: f"regexp_extract(body, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1)"
    plain = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'),
      '&amp;?', '&', 'g'), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' ')"""
    plain = lambda c, p=plain: p.replace("{}", c, 1)
    walls = " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in text.BLOCKERS)
    words = lambda c: f"CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END"
    cut = f"substring(text, 1, {limit})" if limit else "text"
    return rf"""WITH b AS (SELECT page_id, {body} AS body FROM pages),
    p AS (SELECT page_id, coalesce(nullif({inner('article')}, ''), {inner('main')}) AS inside, body FROM b),
    s AS (SELECT page_id, inside <> '' AS explicit, unnest(string_split_regex(CASE WHEN inside <> '' THEN inside ELSE body END, '{markup.BLOCK_TAG}')) AS block,
      generate_subscripts(string_split_regex(CASE WHEN inside <> '' THEN inside ELSE body END, '{markup.BLOCK_TAG}'), 1) AS place FROM p),
    t AS (SELECT page_id, explicit, place, {plain('block')} AS text, {plain("array_to_string(regexp_extract_all(block, '" + markup.ANCHOR + "', 1), ' ')")} AS links FROM s),
    w AS (SELECT page_id, explicit, place, text, {words('text')} AS n, {words('links')} / ({words('text')}) AS d FROM t WHERE text <> ''),
    c AS (SELECT *, d <= 1.0 / 3 AND CASE WHEN coalesce(lag(d) OVER o, 0) <= 5.0 / 9 THEN n > 16 OR coalesce(lead(n) OVER o, 0) > 15 OR coalesce(lag(n) OVER o, 0) > 4
      ELSE n > 40 OR coalesce(lead(n) OVER o, 0) > 17 END AS content FROM w WINDOW o AS (PARTITION BY page_id ORDER BY place)),
    f AS (SELECT *, CASE WHEN explicit THEN d <= 0.5 ELSE content OR (d <= 1.0 / 3 AND coalesce(lag(content) OVER o, false) AND coalesce(lead(content) OVER o, false)) END AS kept
      FROM c WINDOW o AS (PARTITION BY page_id ORDER BY place)),
    g AS (SELECT pages.page_id, coalesce(string_agg(f.text, chr(10) ORDER BY place), '') AS text FROM pages LEFT JOIN f ON f.page_id = pages.page_id AND kept GROUP BY pages.page_id)
    SELECT page_id, CASE WHEN length(text) < {text.BLOCKER_LENGTH} OR {walls} THEN '' ELSE {cut} END AS text FROM g"""


@_query(_main_sql())
def extract_main_text(spark, d):
    return read(spark, d, "pages").select("page_id", markup.main_text(F.col("html")).alias("text"))


@_query(_main_sql(500))
def extract_main_text_500(spark, d):
    return read(spark, d, "pages").select("page_id", markup.main_text(F.col("html"), 500).alias("text"))


@_query(_main_sql().replace("FROM b),", "FROM (SELECT page_id, regexp_replace(body, '</?(article|h1)>', '<div>', 'g') AS body FROM b)),"))
def extract_scored_text(spark, d):
    """The same pages without article elements, so that blocks are scored."""
    return read(spark, d, "pages").select("page_id", markup.main_text(F.regexp_replace("html", "</?(article|h1)>", "<div>")).alias("text"))


_SCORE = "least(100, CAST(floor(length(text) / 20.0) AS INTEGER) + len(string_split(title, ' ')) * 2)"
_TIDY = "trim(regexp_replace({}, ' {{2,}}', ' ', 'g'), ' ' || chr(10))"


def _fetched(spark, d):
    a = articles(spark, d).where("title <> ''")
    return a.select(F.regexp_replace("title", "[‘’‚“”„…]", "x").alias("title"), "url", "content", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_date"), "source", "source_type", F.col("id").alias("pos"))


@_query(f"""WITH {SQL}, f AS (SELECT id AS pos, url, title, content AS text, source, source_type, published_at FROM articles WHERE title <> ''),
known AS (SELECT url FROM pages WHERE page_id % 5 = 0 UNION SELECT url FROM articles WHERE id % 7 = 0),
dead AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages WHERE page_id % 11 = 0),
fresh AS (SELECT * FROM f WHERE url NOT IN (SELECT url FROM known WHERE url IS NOT NULL) AND regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT IN (SELECT host FROM dead)),
j AS (SELECT *, {_SCORE} AS score FROM fresh),
k AS (SELECT * FROM j WHERE score >= 76 QUALIFY row_number() OVER (PARTITION BY url ORDER BY score DESC, pos) = 1),
p AS (SELECT url, max(html) AS fetched FROM pages WHERE page_id % 2 = 0 GROUP BY url),
c AS (SELECT k.*, CASE WHEN source_type IN ('aiNews', 'rss') THEN text ELSE coalesce(fetched, '') END AS "full", {_TIDY.format('title')} AS clean FROM k LEFT JOIN p ON k.url = p.url),
m AS (SELECT *, substring("full", 1, 1500) AS prompt, 'About ' || clean AS better FROM c),
n AS (SELECT *, CASE WHEN "full" <> '' THEN prompt ELSE better END AS about FROM m)
SELECT (SELECT max(id) FROM articles WHERE id % 7 = 0) + row_number() OVER (ORDER BY url) AS id, url, better AS title, source, source_type, score, published_at,
  CASE WHEN "full" <> '' THEN {_TIDY.format('substring(prompt, 1, 120)')} ELSE '' END AS summary,
  list_filter([CASE WHEN length(about) % 2 = 0 THEN 'models' END, CASE WHEN length(about) % 3 = 0 THEN 'dev' END, CASE WHEN length(about) % 5 = 0 THEN 'research' END], lambda x: x IS NOT NULL) AS categories,
  CASE WHEN "full" <> '' THEN CASE WHEN contains(prompt, '|') THEN 'product' WHEN length(prompt) < 400 THEN 'announcement' ELSE 'blog' END
    WHEN contains(better, '|') THEN 'product' ELSE 'announcement' END AS kind,
  md5(CASE WHEN "full" <> '' THEN "full" ELSE text END) AS content, 256 AS dimensions FROM n""")
def article_run(spark, d):
    """The run against known articles (undated, so that none is a recent story), dead hosts and fetched pages; titles are rewritten."""
    pages = read(spark, d, "pages")
    known = articles(spark, d).where("id % 7 = 0").withColumn("published_at", F.lit(None).cast("timestamp"))
    dead = pages.where("page_id % 11 = 0").select(urls.hostname(F.col("url")).alias("host"))
    texts = pages.where("page_id % 2 = 0").groupBy("url").agg(F.max("html").alias("content"))
    scored = pages.where("page_id % 5 = 0").select("url")
    new, _ = articles_run.run(_fetched(spark, d), known, scored, AS_OF, dead, texts, improve=lambda t: F.concat(F.lit('[x] "About '), t, F.lit('"')))
    return new.select(
        "id", "url", "title", "source", "source_type", "score", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "summary", "categories", "kind",
        F.md5(F.col("content").cast("binary")).alias("content"), F.size("embedding").alias("dimensions"),
    )


@_query(f"""WITH {SQL}, f AS (SELECT url FROM articles WHERE title <> ''), known AS (SELECT url FROM pages WHERE page_id % 5 = 0)
SELECT url FROM known UNION SELECT url FROM f WHERE url IS NOT NULL""")
def article_rerun(spark, d):
    """The scored addresses after two runs: the second finds nothing new, and inserts nothing."""
    from ..shared import stored

    none = articles(spark, d).limit(0)
    scored = read(spark, d, "pages").where("page_id % 5 = 0").select("url").distinct()
    fetched = _fetched(spark, d)
    _, scored = articles_run.run(fetched, none, scored, AS_OF)
    again, twice = articles_run.run(fetched, none, stored(scored.where("url is not null"), "scored"), AS_OF)
    return twice.select("url").unionByName(again.select(F.concat(F.lit("inserted again: "), "url").alias("url"))).where("url is not null").distinct()


# --- lookups, list steps, feeds ---------------------------------------------------------------------------


@_query(f"WITH {SQL} SELECT id, title FROM articles WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def lookup_articles(spark, d):
    keys = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return feed.lookup(articles(spark, d, url=False), keys, "id").select("id", "title")


@_query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 1")
def first_customer(spark, d):
    return feed.first_where(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_nationkey", 7, "c_custkey")


@_query(f"WITH {SQL} SELECT id FROM articles WHERE published_at >= TIMESTAMP '2026-06-15 00:00:00'")
def recent_articles(spark, d):
    return articles_run.recent(articles(spark, d, url=False), AS_OF).select("id")


@_query(f"WITH {SQL} SELECT count(*) AS count FROM (SELECT id FROM articles WHERE score IS NOT NULL AND embedding IS NOT NULL LIMIT 20)")
def search_count(spark, d):
    """A reader searches; the filters that are set don't count."""
    import pandas as pd

    embed = lambda rows: pd.DataFrame({"id": rows.id, "embedding": [[0.05] * 64]})
    return feed.found_count(feed.browse(articles(spark, d, embedding=True), AS_OF, "agents", embed, min_score=9, kind="paper"))


@_query("SELECT coalesce(CASE WHEN page_id % 3 <> 0 THEN url END, 'None') AS url, 't' || page_id AS title, 's' AS source FROM pages")
def story_inputs(spark, d):
    url = F.when(F.col("page_id") % 3 != 0, F.col("url"))
    return steps.known_story_inputs(read(spark, d, "pages").select(url.alias("url"), F.concat(F.lit("t"), "page_id").alias("title"), F.lit("s").alias("source"), "html"))


@_query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN coalesce('s' || quality, '') ELSE text END) AS content FROM documents LEFT JOIN (SELECT doc_id AS l, max(quality) AS quality FROM labels GROUP BY 1) ON doc_id = l")
def snippet_fill(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.col("text")).alias("content"))
    given = read(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("url")).agg(F.concat(F.lit("s"), F.max("quality")).alias("snippet"))
    return steps.fill_snippets(rows, given).select("doc_id", F.md5(F.col("content").cast("binary")).alias("content"))


@_query("SELECT page_id FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) NOT IN (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) FROM pages WHERE page_id % 13 = 0)")
def living_hosts(spark, d):
    p = read(spark, d, "pages").select("page_id", "url")
    return steps.dead_hosts(p, p.where("page_id % 13 = 0").select(urls.hostname(F.col("url")).alias("host"))).select("page_id")


@_query(f"WITH {SQL} SELECT id, md5(CASE WHEN id % 4 <> 0 AND summary <> '' THEN title || chr(10) || chr(10) || summary ELSE title END) AS text FROM articles")
def embedding_texts(spark, d):
    a = articles(spark, d, url=False).withColumn("summary", F.when(F.col("id") % 4 != 0, F.col("summary")))
    return steps.embedding_inputs(a).select("id", F.md5(F.col("text").cast("binary")).alias("text"))


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def delete_by_key(spark, d):
    gone = read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.delete_keys(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), gone, "o_orderkey")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def column_update(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changes = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "new").alias("o_orderstatus"))
    return state.update(o, changes, "o_orderkey", ["o_orderstatus"])


@_query("SELECT c_custkey FROM customer UNION ALL SELECT CAST(-1 AS BIGINT)")
def bootstrap_row(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    once = state.add_if_absent(c, spark.createDataFrame([(-1,)], "c_custkey long"), "c_custkey")
    return state.add_if_absent(once, spark.createDataFrame([(-1,)], "c_custkey long"), "c_custkey")


@_query("SELECT vec_id, NULL::FLOAT[] AS embedding FROM embeddings")
def reset_column(spark, d):
    from .. import schema

    return schema.reset_column(read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", "array<float>")


@_query("SELECT c_custkey, upper(substring(split_part(c_name, '#', 1), 1, 1) || coalesce(substring(split_part(c_name, '#', 2), 1, 1), '')) AS initials FROM customer")
def name_initials(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.initials(F.regexp_replace("c_name", "#", " ")).alias("initials"))


@_query("SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[^a-zA-Z,]', ' ', 'g'), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents")
def list_from_csv(spark, d):
    return read(spark, d, "documents").select("doc_id", text.split_list(F.regexp_replace("text", "[^a-zA-Z,]", " ")).alias("parts"))


@_query(f"WITH {SQL} SELECT id, list_transform(categories, lambda x: lower(x)) AS categories, categories AS again FROM articles")
def list_column(spark, d):
    """Lists lowered, and lists written as JSON and read again."""
    c = F.col("categories")
    shouted = F.transform(c, lambda x: F.upper(x))
    return articles(spark, d, url=False).select("id", text.lowered(shouted).alias("categories"), text.json_list(text.list_json(c)).alias("again"))


@_query("SELECT event_id, strftime(ts, '%b %-d') AS shown, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def shown_dates(spark, d):
    return read(spark, d, "events").select("event_id", dates.short_text(F.col("ts")).alias("shown"), dates.iso_text(F.col("ts")).alias("iso"))


@_query("SELECT event_id, CASE WHEN event_id % 10 > 0 THEN make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) END AS at FROM events")
def epoch_dates(spark, d):
    seconds = F.when(F.col("event_id") % 10 > 0, F.unix_timestamp(F.col("ts").cast("timestamp"))).otherwise(F.when(F.col("event_id") % 20 > 0, 0))
    return read(spark, d, "events").select("event_id", dates.from_epoch(seconds).cast("timestamp_ntz").alias("at"))


@_query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id WHEN doc_id % 3 = 1 THEN 'old' ELSE 'old' END) AS title FROM documents")
def title_guard(spark, d):
    """Rewritten titles that are wrapped, that name the source, or that are empty."""
    new = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('3. "Title '), "doc_id", F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("By "), F.upper("source"))).otherwise("")
    return read(spark, d, "documents").select("doc_id", F.md5(text.accept_title(new, F.lit("old"), F.col("source")).cast("binary")).alias("title"))


@_query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'repo' WHEN page_id % 3 = 1 THEN 'blog' ELSE 'paper' END AS kind, 'https://github.com/o/r' || page_id AS repo FROM pages")
def resolved_kind(spark, d):
    i = F.col("page_id")
    content = F.when(i % 3 == 0, F.concat(F.col("html"), F.lit(" see https://github.com/o/r"), i)).when(i % 3 == 1, "see https://github.com/features/x and https://github.com/a/b").otherwise("")
    url = F.when(i % 3 == 2, "https://arxiv.org/abs/1").otherwise(F.col("url"))
    repo = urls.repo_from_text(F.concat(F.lit("at https://www.github.com/o/r"), i, F.lit(" and more")))
    return read(spark, d, "pages").select("page_id", urls.resolve_kind(url, F.lit("BLOG"), content).alias("kind"), repo.alias("repo"))


@_query("SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;?', '&', 'g')) AS html FROM pages")
def unescape_html(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(text.unescape(F.col("html")).cast("binary")).alias("html"))


@_query("""SELECT 'https://' || page_id || CASE WHEN page_id % 5 = 0 THEN '.x.com/' ELSE '.example.com/' END AS url,
  md5(CASE WHEN page_id % 5 = 0 OR page_id % 3 = 0 OR page_id % 4 = 0 THEN '' ELSE html END) AS html FROM pages""")
def fetched_html(spark, d):
    """The rules of the page fetcher over stored answers: hosts that aren't fetched, failures and other content give nothing."""
    from ..sources import pages as fetcher

    i = F.col("page_id")
    url = F.concat(F.lit("https://"), i, F.when(i % 5 == 0, ".x.com/").otherwise(".example.com/"))
    p = read(spark, d, "pages").select(url.alias("url"), F.when(i % 3 == 0, 404).otherwise(200).alias("status"), F.when(i % 4 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), F.col("html").alias("body"))
    return fetcher.html_of(p, p).select("url", F.md5(F.col("html").cast("binary")).alias("html"))


@_query("""SELECT coalesce(CASE WHEN doc_id % 4 > 0 THEN 't' || doc_id END, '(no title)') AS title, CASE WHEN doc_id % 5 > 0 THEN 'https://f/' || doc_id ELSE '' END AS url,
  md5(coalesce(text, '')) AS content, CASE WHEN doc_id % 2 = 0 THEN '2026-06-28T00:00:00Z' WHEN doc_id % 3 = 0 THEN '' ELSE 'Sun, 28 Jun 2026 01:00:00 GMT' END AS published_date,
  source, 'rss' AS source_type, doc_id % 20 * 100000 + doc_id AS pos FROM documents WHERE doc_id % 7 > 0 OR doc_id % 2 > 0""")
def newsletter_entries(spark, d):
    """Feed entries with missing titles, addresses and dates; some of the first are old."""
    from ..sources import snapshots

    i = F.col("doc_id")
    published = F.when(i % 2 == 0, F.when(i % 7 == 0, "2026-01-01T00:00:00Z").otherwise("2026-06-28T00:00:00Z")).otherwise("")
    updated = F.when((i % 2 > 0) & (i % 3 > 0), "Sun, 28 Jun 2026 01:00:00 GMT")
    rows = read(spark, d, "documents").select(
        F.when(i % 4 > 0, F.concat(F.lit("t"), i)).alias("title"), F.when(i % 5 > 0, F.concat(F.lit("https://f/"), i)).alias("link"), F.col("text").alias("summary"), published.alias("published"),
        updated.alias("updated"), F.col("source").alias("name"), (i % 20).alias("feed"), i.alias("entry"),
    )
    return snapshots.newsletter_feeds(rows, AS_OF).withColumn("content", F.md5(F.col("content").cast("binary")))


@_query("""SELECT 'GPT story ' || doc_id AS title, CASE WHEN doc_id % 3 > 0 THEN 'https://s/' || doc_id ELSE 'https://news.ycombinator.com/item?id=' || doc_id END AS url, '' AS content,
  CASE WHEN doc_id % 5 > 0 THEN '2026-06-28T00:00:00.000000' ELSE '2026-06-29T00:00:00.000000' END AS published_date, 'Hacker News' AS source, 'hackerNews' AS source_type, doc_id AS pos
  FROM documents WHERE doc_id < 200 AND doc_id % 2 = 0 AND doc_id % 7 > 0 AND doc_id % 11 > 0""")
def top_stories(spark, d):
    """A list of top stories, of which the source takes the first 200 (that is its rule): no comments, none off the topic, none old."""
    from ..sources import snapshots

    i = F.col("doc_id")
    items = read(spark, d, "documents").select(
        i.alias("id"), F.when(i % 2 == 0, "story").otherwise("comment").alias("type"), F.concat(F.lit("Show HN: "), F.when(i % 7 > 0, "GPT").otherwise("Knitting"), F.lit(" story "), i).alias("title"),
        F.when(i % 3 > 0, F.concat(F.lit("https://s/"), i)).alias("url"), F.when(i % 11 == 0, 1_000_000_000).when(i % 5 > 0, 1_782_604_800).cast("long").alias("time"),
    )
    top = items.agg(F.sequence(F.min("id"), F.max("id")).alias("ids"))
    return snapshots.hacker_news(top, items, AS_OF)


_PLAIN = r"trim(regexp_replace(translate(substring(text, 1, 300), '<>&]', '    '), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' ')"


@_query(rf"""WITH r AS (SELECT doc_id, {_PLAIN} AS body FROM documents WHERE doc_id % 10 > 0 AND doc_id % 7 > 0)
SELECT 'A title of ' || doc_id AS title, 'https://github.com/o/r' || doc_id AS url, md5(CASE WHEN body <> '' THEN body ELSE 'A title of ' || doc_id || ' x' END) AS content FROM r
UNION ALL SELECT 'Post ' || doc_id, 'https://reddit.com/r/a/comments/' || doc_id, md5(trim('Post ' || doc_id || ' ' || body, ' ')) FROM r WHERE length(trim('Post ' || doc_id || ' ' || body, ' ')) >= 120""")
def recap_stories(spark, d):
    """Recap issues as a feed carries them: the post of the first section and the threads of the second; quiet and old issues give none."""
    from ..sources import snapshots

    i = F.col("doc_id").cast("string")
    body = text.whitespace_norm(F.translate(F.substring("text", 1, 300), "<>&]", "    "))
    html = F.concat(
        F.lit("<h1>AI Twitter Recap</h1><p><strong>A title of "), i, F.lit('</strong> <a href="https://github.com/o/r'), i, F.lit('">x</a></p><ul><li>'), body, F.lit("</li></ul>"),
        F.lit('<h1>AI Reddit Recap</h1><a href="https://reddit.com/r/a/comments/'), i, F.lit('">Post '), i, F.lit("</a> "), body, F.lit("<h2>End</h2> of it"),
    )
    title = F.when(F.col("doc_id") % 7 == 0, "Not much happened today").otherwise(F.concat(F.lit("Issue "), i))
    date = F.when(F.col("doc_id") % 10 == 0, "1 Jan 2026 00:00:00 EST").otherwise("Sun, 28 Jun 2026 10:00:00 GMT")
    xml = F.concat(F.lit("<rss><item><title>"), title, F.lit("</title><link>l</link><content:encoded><![CDATA["), html, F.lit("]]></content:encoded><pubDate>"), date, F.lit("</pubDate></item></rss>"))
    found = snapshots.recap_feed(read(spark, d, "documents").select(F.coalesce(xml, F.lit("")).alias("xml")), AS_OF)
    return found.select("title", "url", F.md5(F.col("content").cast("binary")).alias("content"))


@_query(rf"""WITH r AS (SELECT doc_id, replace({_PLAIN}, '"', '') AS body FROM documents),
a AS (SELECT doc_id, '<a href="https://reddit.com/r/a/comments/1">T one</a> ' || body AS one, '<a class=x href="https://www.reddit.com/r/b/comments/2">T two</a> ' || body AS two FROM r)
SELECT doc_id, 0 AS n, md5(one) AS segment FROM a UNION ALL SELECT doc_id, 1, md5(two) FROM a""")
def thread_segments(spark, d):
    """A threads section cut at its thread links; the last thread ends at a heading."""
    body = F.regexp_replace(text.whitespace_norm(F.translate(F.substring("text", 1, 300), "<>&]", "    ")), '"', "")
    one = F.concat(F.lit('<a href="https://reddit.com/r/a/comments/1">T one</a> '), body)
    two = F.concat(F.lit('<a class=x href="https://www.reddit.com/r/b/comments/2">T two</a> '), body)
    html = F.concat(F.lit("<h1>AI Reddit Recap</h1>intro "), one, two, F.lit("<h3>Next</h3> more"))
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(markup.thread_segments(html)).alias("n", "segment"))
    return rows.select("doc_id", "n", F.md5(F.col("segment").cast("binary")).alias("segment"))


# --- discovery ----------------------------------------------------------------------------------------------


@_query("SELECT c_name AS handle, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS verdict FROM customer")
def profile_verdicts(spark, d):
    c = read(spark, d, "customer")
    verdicts = c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("handle"), F.explode(F.array(F.lit("first"), "c_mktsegment")).alias("verdict"))
    verdicts = verdicts.withColumn("pos", F.when(F.col("verdict") == "first", 0).otherwise(1))
    return discover.with_verdicts(c.select(F.col("c_name").alias("handle")), verdicts)


@_query(rf"""SELECT page_id, list_transform(list_zip(regexp_extract_all(html, {_LINK}, 1), regexp_extract_all(html, {_LINK}, 2)),
  lambda x: regexp_replace(regexp_replace(x[1], '([?&])utm_[^&#]*&?', '\1', 'g'), '[?&]+(#|$)', '\1', 'g') || ' ' || trim(regexp_replace(regexp_replace(x[2], '<[^>]+>', ' ', 'g'), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ')) AS links FROM pages""")
def page_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.transform(discover.links(F.col("html")), lambda x: F.concat_ws(" ", x["url"], x["text"])).alias("links"))


_ENTRIES = r"list_transform(regexp_extract_all(html, '<li>([\s\S]*?)</li>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' '))"


@_query(rf"""WITH e AS (SELECT page_id, {_ENTRIES} AS entries FROM pages)
SELECT page_id, list_transform(list_filter(entries, lambda x: length(x) >= 20), lambda x: split_part(x, ' ', 1)) AS kept, len(entries) AS n,
  list_transform(entries, lambda x, i: CASE WHEN length(x) >= 20 THEN i END)[1] = 1 AS first_kept FROM e""")
def page_products(spark, d):
    """The list entries of pages as products, and of these the notable ones by number."""
    rows = read(spark, d, "pages").select("page_id", discover.products(F.col("html")).alias("found")).withColumn("numbers", discover.notable(F.col("found")))
    names = F.transform(discover.kept(F.col("found"), F.col("numbers")), lambda p: p["name"])
    first = F.when(F.length(F.get(F.col("found"), 0)["description"]) >= discover.NOTABLE_LENGTH, F.get(F.col("numbers"), 0) == 1)
    return rows.select("page_id", names.alias("kept"), F.size("found").cast("long").alias("n"), first.alias("first_kept"))


@_query(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, {_LINK}, 1) AS urls, CASE page_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'AN' ELSE 'no such product' END AS name FROM pages),
c AS (SELECT page_id, urls, coalesce(list_position(list_transform(urls, lambda x: contains(lower(x), lower(name))), true), 0) AS number FROM l)
SELECT page_id, CAST(number AS INTEGER) AS number, CASE WHEN number > 0 THEN urls[number] END AS url,
  CASE WHEN number = 0 THEN 0.0::DOUBLE WHEN contains(lower(regexp_extract(urls[number], '^[A-Za-z]+://([^/?#]*)', 1)), CASE page_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'an' ELSE 'nosuchproduct' END)
    THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM c""")
def product_link(spark, d):
    """The candidate that fits a product's name, by number, and the candidate at that number."""
    name = F.when(F.col("page_id") % 3 == 0, "the").when(F.col("page_id") % 3 == 1, "AN").otherwise("no such product")
    found = F.transform(F.regexp_extract_all("html", F.lit(markup.LINK), F.lit(1)), lambda u: F.struct(u.alias("url"), F.lit("").alias("text")))
    rows = read(spark, d, "pages").select("page_id", found.alias("candidates"), name.alias("name")).withColumn("number", discover.choose(F.col("name"), F.col("candidates")))
    rows = rows.withColumn("chosen", discover.chosen(F.col("candidates"), F.col("number")))
    return rows.select("page_id", "number", F.col("chosen.url").alias("url"), discover.confidence(F.col("name"), F.col("chosen")).alias("confidence"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
