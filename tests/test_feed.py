import itertools
import tracemalloc

import numpy as np
import pytest

from newsmill.operators import feed
from newsmill.plans.articles import AS_OF, articles


@pytest.fixture(scope="module")
def table(spark, sf):
    return articles(spark, sf).cache()


FILTERS = {"min_score": 8, "category": "dev", "kind": "blog", "since": "2026-06-20T00:00:00"}


def test_filters_are_sound(table):
    rows = feed.feed(table, AS_OF, limit=50, category="dev").collect()
    assert rows and all("dev" in r.categories for r in rows)
    rows = feed.feed(table, AS_OF, limit=50, min_score=9, kind="blog").collect()
    assert rows and all(r.score >= 9 and r.kind == "blog" for r in rows)


def test_a_filter_never_adds(table):
    n = lambda **f: feed.feed_count(table, AS_OF, **f).first()[0]
    for a, b in itertools.combinations(FILTERS, 2):
        one, both = n(**{a: FILTERS[a]}), n(**{a: FILTERS[a], b: FILTERS[b]})
        assert both <= one <= n()


def test_orders(table):
    s = [r.score for r in feed.feed(table, AS_OF, sort="whatever").collect()]
    assert s == sorted(s, reverse=True)
    d = [r.published_at for r in feed.feed(table, AS_OF, sort="published_at").collect()]
    assert d == sorted(d, reverse=True)


def test_since(table):
    wide = {r.id for r in feed.feed_filter(table, AS_OF, since="2026-06-01").collect()}
    assert {r.id for r in feed.feed_filter(table, AS_OF, since="2026-06-20").collect()} <= wide
    assert feed.feed_count(table, AS_OF, since="no date").first() == feed.feed_count(table, AS_OF).first()


def test_limits(table):
    for bad in (0, 51):
        with pytest.raises(ValueError):
            feed.feed(table, AS_OF, limit=bad)
    with pytest.raises(ValueError):
        feed.feed(table, AS_OF, min_score=11)


def test_count_is_before_the_limit(table):
    assert feed.feed_count(table, AS_OF).first()[0] > feed.feed(table, AS_OF, limit=5).count() == 5


def test_stats_of_nothing(table):
    assert tuple(feed.stats(table.limit(0)).first()) == (0, None)


def test_search_batch_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(70, 6)).round(1)
    x[10], x[11], x[12] = x[9], x[9], 0
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)] + [(99, None)], "id long, embedding array<double>").repartition(3)
    q = v.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    rows = lambda **kw: sorted((a.query_id, a.rank, a.id) for a in feed.search_batch(v, q, 4, digits=6, **kw).collect())
    assert rows() == rows(query_rows=5, vector_rows=20)
    assert len(rows()) == 14 * 4 and feed.search_batch(v, q.limit(0), 4).count() == feed.search_batch(v.limit(0), q, 4).count() == 0


@pytest.mark.parametrize("digits", [None, 2])
def test_nearest_in_tiles(monkeypatch, digits):
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 8))
    x[100:400] = x[7]  # more copies than k, in several tiles
    x[500:505] = 0
    q = np.concatenate([x[[7, 3, 500]], r.normal(size=(40, 8))])
    ids = r.permutation(700) + 10
    with np.errstate(all="ignore"):
        d = 1 - (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    want = [[int(i) for _, i in sorted((round(v, digits or 12) if v == v else 9.0, i) for v, i in zip(row, ids))[:10]] for row in d]
    monkeypatch.setattr(feed, "TILE", (16, 64))
    best = feed.Nearest(np.arange(len(q)), q, 10, digits or 12)
    for at in np.array_split(np.arange(700), 3):
        best.add(ids[at], x[at])
    got = best.frame()
    assert got.groupby("query_id").id.apply(list).tolist() == want
    assert got[got.query_id == 2].distance.isna().all() and not got[got.query_id != 2].distance.isna().any()


def test_nearest_holds_one_tile():
    r = np.random.default_rng(5)
    q, x = r.normal(size=(4000, 16)), r.normal(size=(10_000, 16))
    best = feed.Nearest(np.arange(len(q)), q, 10, 6)
    tracemalloc.start()
    best.add(np.arange(len(x)), x)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 64e6  # the whole matrix has 320 MB
