from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsmill import articles_run, models, schema
from newsmill.operators import state, steps


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_picks(spark):
    df = spark.createDataFrame([("u", 80, 0, "first"), ("u", 80, 1, "second"), ("v", 1, 2, "x"), ("v", 3, 3, "y"), (None, 1, 4, "z")], "url string, score int, pos int, name string")
    assert {r.name for r in state.argmax(df, "url", "score", "pos").collect()} == {"first", "y", "z"}
    assert {r.name for r in state.first_wins(df, "url", "pos").collect()} == {"first", "x", "z"}
    assert {r.name for r in state.last_wins(df, "url", "pos").collect()} == {"second", "y", "z"}


def test_upserts(spark):
    old = spark.createDataFrame([("a", None), ("b", None)], "url string, scored_at timestamp")
    new = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "url string")
    assert [r.url for r in state.upsert_keys(old, new, "url").orderBy("url").collect()] == ["a", "b", "c"]
    at, later = datetime(2026, 1, 1), datetime(2026, 2, 1)
    subs = spark.createDataFrame([("a@x", ["dev"], None, None, at, at)], schema.SUBSCRIBER)
    more = spark.createDataFrame([("a@x", [], "mine", "web", 1), ("b@x", ["models"], None, None, 2), ("bad", [], None, None, 3), ("a@x", ["research"], None, None, 4)], "email string, categories array<string>, custom_category string, utm_source string, pos int")
    out = {r.email: r for r in state.upsert_subscribers(subs, more, later).collect()}
    assert set(out) == {"a@x", "b@x"}
    assert (out["a@x"].categories, out["a@x"].created_at, out["a@x"].updated_at) == (["research"], at, later)
    assert out["b@x"].created_at == later


def test_updates_and_deletes(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, name string, n int")
    change = spark.createDataFrame([(1, None, True), (2, "x", False)], "id int, name string, name_set boolean")
    assert rows(state.update_set(df, change, "id", ["name"]), "id") == [(1, None, 1), (2, "b", 2), (3, None, 3)]
    assert rows(state.update(df, change, "id", ["name"]), "id") == [(1, "a", 1), (2, "x", 2), (3, None, 3)]
    assert rows(state.delete_where(df, F.col("name") == "a"), "id") == [(2, "b", 2), (3, None, 3)]
    assert rows(state.add_if_absent(df, spark.createDataFrame([(3, "z"), (4, "z")], "id int, name string"), "id"), "id")[-1] == (4, "z", None)
    assert rows(schema.add_columns(df, extra="string", n="int"), "id")[0] == (1, "a", 1, None)
    numbered = state.next_ids(df, spark.range(100).select(F.col("id").cast("string").alias("key")), "id", "key")
    assert sorted(r.id for r in numbered.collect()) == list(range(4, 104))


def test_steps(spark):
    a = spark.createDataFrame([("u1", "Ben's Bites"), ("u2", "Ben's Bites"), ("u3", "x"), ("u4", "x")], "url string, source string")
    v = spark.createDataFrame([("u1", 66, 0), ("u2", 95, 1), ("u3", 10, 2), ("u3", 80, 3)], "url string, score int, pos int")
    s = steps.with_scores(a, v)
    assert {r.url: r.score for r in s.collect()} == {"u1": 76, "u2": 100, "u3": 80, "u4": 0}
    assert {r.url for r in steps.passing(s).collect()} == {"u1", "u2", "u3"}
    b = steps.batches(spark.range(12), "id")
    assert [r.batch for r in b.orderBy("id").collect()] == [0] * 5 + [1] * 5 + [2] * 2
    hosts = spark.createDataFrame([("dead.com",)], "host string")
    u = spark.createDataFrame([("https://dead.com/a",), ("https://ok.com",), ("nohost",), (None,)], "url string")
    assert [r.url for r in steps.dead_hosts(u, hosts).collect()] == ["https://ok.com"]


def test_near_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    assert [(r.a, r.b) for r in steps.near_vectors(v, 0.9).collect()] == [(1, 2)]
    assert [r.id for r in steps.without_stories(v.where("id = 2 or id = 3"), v.where("id = 1"), 0.9).collect()] == [3]


def test_near_vectors_loses_no_pair(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(steps, "CENTRES", 12)
    r = np.random.default_rng(1)
    x = np.concatenate([c + 0.2 * r.normal(size=(25, 8)) for c in r.normal(size=(8, 8))] + [r.normal(size=(60, 8))])
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for least in (0.2, 0.9, 0.99):
        want = {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if u[i] @ u[j] >= least}
        got = [(p.a, p.b) for p in steps.near_vectors(v, least, rows=10).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_run_twice(spark, sf):
    from newsmill.plans.articles import AS_OF, articles

    a = articles(spark, sf)
    fetched = a.where("title <> ''").select("title", "url", "content", F.lit("2026-06-29T00:00:00Z").alias("published_date"), "source", "source_type", F.col("id").alias("pos"))
    none = a.limit(0)
    scored = spark.createDataFrame([], "url string")
    new, scored = articles_run.run(fetched, none, scored, AS_OF)
    urls = [r.url for r in new.collect()]
    assert urls and len(urls) == len(set(urls))
    again, _ = articles_run.run(fetched, none, scored.cache(), AS_OF)
    assert again.count() == 0


def test_run_drops_known_stories_and_embeds(spark):
    from datetime import timedelta

    import numpy as np

    at = datetime(2026, 6, 29)
    titles = ["a new model is out today", "some old story told again", "an undated story told again", "nothing like the others here", "A New Model is out today"]
    rows = [(t, f"https://h.x/{i}", "word " * 400, "2026-06-29T00:00:00Z", "s", "rss", i) for i, t in enumerate(titles)]
    rows.append(("another title of the first URL", "https://h.x/0", "word " * 400, "2026-06-29T00:00:00Z", "s", "rss", 9))
    fetched = spark.createDataFrame(rows, schema.FETCHED + ", pos int")
    day = lambda n: at - timedelta(days=n)
    known = [(1, titles[0], "https://other.x/1", day(3)), (2, titles[1], "https://other.x/2", day(15)), (3, titles[2], "https://other.x/3", None), (4, "unrelated", "https://h.x/3", day(1))]
    articles = spark.createDataFrame(known, "id long, title string, url string, published_at timestamp")
    new, scored = articles_run.run(fetched, articles, spark.createDataFrame([], "url string"), at)
    got = {r.url: r for r in new.collect()}
    assert set(got) == {r.url for r in scored.collect()} == {"https://h.x/1", "https://h.x/2"}
    for r in got.values():
        want = models.hashed_embedding(__import__("pandas").DataFrame({"id": [0], "text": [f"{r.title}\n\n{r.summary}"]})).embedding[0]
        assert np.allclose(r.embedding, want, atol=1e-6)


def test_model_errors(spark):
    df = spark.range(7)

    def call(rows):
        if 3 in set(rows.id):
            raise RuntimeError("no answer")
        return rows.assign(y=rows.id * 2)

    out = models.apply(df.coalesce(1), call, "id long, y double", chunk=2, on_error="keep").collect()
    assert {r.id for r in out if r.error} == {2, 3} and {r.y for r in out if not r.error} == {0, 2, 8, 10, 12}
    with pytest.raises(Exception, match="no answer"):
        models.apply(df, call, "id long, y double").collect()


def test_hashed_embedding():
    import pandas as pd

    e = models.hashed_embedding(pd.DataFrame({"id": [1, 2], "text": ["a b", None]}))
    assert len(e.embedding[0]) == 256 and sum(x * x for x in e.embedding[0]) == pytest.approx(1) and set(e.embedding[1]) == {0.0}


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"k{i * 37 % 101:03}", None if i % 5 == 0 else f"b{i % 3}", "x", i) for i in range(101)], "name string, by string, part string, n int").repartition(5)
    got = sorted((r.number, r.name) for r in state.numbered(rows, "name").collect())
    assert got == list(enumerate(sorted(f"k{i:03}" for i in range(101)), 1))
    within = {}
    for r in state.numbered(rows, "name", "by").collect():
        within.setdefault(r.by, []).append((r.number, r.name))
    assert set(within) == {None, "b0", "b1", "b2"}
    for found in within.values():
        assert [n for n, _ in sorted(found)] == list(range(1, len(found) + 1)) and [x for _, x in sorted(found)] == sorted(x for _, x in found)
    assert state.numbered(rows.limit(0), "name").count() == 0
    ids = state.next_ids(spark.createDataFrame([], "id long"), rows.select("name"), "id", "name").collect()
    assert sorted(r.id for r in ids) == list(range(1, 102))
    assert state.with_uuid(rows).select("id").distinct().count() == 101


def test_run_counts_its_steps(spark):
    rows = [(f"title {i} of a story", f"https://h{i % 4}.x/{i}", "word " * (400 if i % 2 else 2), "2026-06-29T00:00:00Z", "zz", "rss", i) for i in range(20)]
    fetched = spark.createDataFrame(rows, schema.FETCHED + ", pos int")
    known = spark.createDataFrame([(9, "t", "https://h1.x/1", None)], "id long, title string, url string, published_at timestamp")
    dead = spark.createDataFrame([("h3.x",)], "host string")
    counters = {}
    new, _ = articles_run.run(fetched, known, spark.createDataFrame([], "url string"), datetime(2026, 6, 29), dead, improve=lambda t: F.upper(t), counters=counters)
    got = new.orderBy("id").collect()
    assert {k: c.get["rows"] for k, c in counters.items()} == {"fetched": 20, "unknown": 19, "alive": 14, "kept": 4}
    assert [r.id for r in got] == [10, 11, 12, 13] and [r.url for r in got] == sorted(r.url for r in got)
    assert all(r.title == r.title.upper() for r in got)


def test_ranked(spark):
    rows = spark.createDataFrame([(1, 5, 3), (2, 9, 2), (3, 5, 1)], "id int, score int, pos int")
    assert [r.id for r in steps.ranked(rows).collect()] == [2, 3, 1]


def fake_model():
    class FakeModel:
        """Answers by rule, and fails where told to."""

        def score(self, rows):
            assert len(rows) <= 5 and set(rows.columns) == {"url", "title", "source", "snippet", "trust"}
            return rows.assign(score=[90 if "good" in t else 70 for t in rows.title])[["url", "score"]]

        def improve_titles(self, rows):
            if "fails" in rows.title.iloc[0]:
                raise RuntimeError("no title")
            return rows.assign(title='"Better ' + rows.title + '"')[["url", "title"]]

        def summarize(self, rows):
            if "broken" in rows.title.iloc[0]:
                raise RuntimeError("no summary")
            return rows.assign(summary=rows.content.str[:4] + "…", categories=[["Models"]] * len(rows), kind="BLOG")[["id", "summary", "categories", "kind"]]

        def categorize(self, rows):
            return rows.assign(categories=[["DEV"]] * len(rows))[["id", "categories"]]

        def classify_kind(self, rows):
            return rows.assign(kind="Product")[["id", "kind"]]

        def embed(self, rows):
            return models.hashed_embedding(rows)

        def same_story(self, rows):
            return rows[rows.title.str[:12] == rows.known_title.str[:12]][["url", "known_url"]]

    return FakeModel()


def test_run_with_a_model(spark):
    titles = ["a good one", "a weak one", "good but fails", "good broken one", "good old tale told anew", "good without text"]
    rows = [(t, f"https://h.x/{i}", "" if "without" in t else f"text {i}", "2026-06-29T00:00:00Z", "Ben's Bites" if "weak" in t else "zz", "hackerNews" if "without" in t else "rss", i) for i, t in enumerate(titles)]
    fetched = spark.createDataFrame(rows, schema.FETCHED + ", pos int")
    at = datetime(2026, 6, 29)
    articles = spark.createDataFrame([(4, "good old tale told before", "https://o.x/1", at, "s")], "id long, title string, url string, published_at timestamp, source string")
    new, scored = articles_run.run(fetched, articles, spark.createDataFrame([], "url string"), at, model=fake_model())
    got = {r.url[-1]: r for r in new.collect()}
    assert {k: (r.id, r.title, r.score, r.summary, r.categories, r.kind) for k, r in got.items()} == {
        "0": (5, "Better a good one", 90, "text...", ["models"], "blog"),
        "1": (6, "Better a weak one", 80, "text...", ["models"], "blog"),
        "2": (7, "good but fails", 90, "text...", ["models"], "blog"),
        "3": (8, "Better good broken one", 90, "", [], None),
        "5": (9, "Better good without text", 90, "", ["dev"], "product"),
    }
    assert {r.url for r in scored.collect()} == {f"https://h.x/{i}" for i in (0, 1, 2, 3, 5)}
