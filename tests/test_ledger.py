"""The ledger of model calls, the embedder's cache and the sink of responses."""

import glob
import json
import os
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsmill import ledger
from newsmill.functions import vectors
from newsmill.operators import feed
from newsmill.sources import responses

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see the folder of the tests


def told(folder, what):
    """What the tasks noted in files, as they run in other processes."""
    return sorted(x for f in glob.glob(f"{folder}/{what}-*") for x in open(f).read().split("\n") if x)


def note(folder, what, *xs):
    with open(f"{folder}/{what}-{os.getpid()}", "a") as f:
        f.write("".join(f"{x}\n" for x in xs))


def rows(spark, n, part=1):
    return spark.createDataFrame([(i, f"t{i // 2}") for i in range(n)], "id long, text string").repartition(part, "text")


def test_a_rerun_asks_for_what_is_missing(spark, tmp_path):
    log, book = str(tmp_path), ledger.Ledger(spark, f"file://{tmp_path}/ledger")

    def call(broken):
        def score(part: pd.DataFrame) -> pd.DataFrame:
            if broken and len(told(log, "asked")) >= 12:
                raise OSError("model is down")
            note(log, "asked", *part.text)
            return pd.DataFrame({"score": part.text.str[1:].astype(int) * 10})

        return score

    df = rows(spark, 40)  # 20 different texts
    with pytest.raises(Exception, match="model is down"):
        book.ask(df, "score", ["text"], call(True), "score int", chunk=3, attempts=2, backoff=0.01)
    first = told(log, "asked")
    assert 12 <= len(first) < 20
    assert book.answers("score", "score int").count() == len(first)
    got = book.ask(df, "score", ["text"], call(False), "score int", chunk=3)
    assert sorted((r.id, r.score) for r in got.collect()) == [(i, i // 2 * 10) for i in range(40)]
    assert told(log, "asked") == sorted(f"t{i}" for i in range(20))  # each content once, in both runs together
    again = book.ask(df.withColumn("other", F.lit(1)), "score", ["text"], call(False), "score int")
    assert again.where("score is null").count() == 0 and len(told(log, "asked")) == 20
    book.compact("score", "score int")
    assert book.answers("score", "score int").count() == 20 and sorted((r.id, r.score) for r in book.ask(df, "score", ["text"], None, "score int").collect())[-1] == (39, 190)
    assert book.ask(df, "other", ["text"], call(False), "score int").count() == 40 and len(told(log, "asked")) == 40  # another step asks anew


def test_a_run_is_repeated_without_asking_again(spark, tmp_path):
    from datetime import datetime

    from newsmill import articles_run

    log = str(tmp_path)

    def fake(broken):
        class Fake:
            def score(self, part):
                note(log, "score", *part.url)
                return part.assign(score=90)[["url", "score"]]

            def improve_titles(self, part):
                return part.assign(title="Better " + part.title)[["url", "title"]]

            def summarize(self, part):
                if broken and part.title.iloc[0].endswith("7"):
                    os._exit(1)  # a lost worker
                note(log, "summary", *part.title)
                return pd.DataFrame({"id": part.id, "summary": ["s"] * len(part), "categories": [["dev"]] * len(part), "kind": ["blog"] * len(part)})

            def categorize(self, part):
                raise AssertionError("every article has a text")

            classify_kind = categorize

        return Fake()

    fetched = spark.createDataFrame([(f"title {i}", f"https://h.x/{i}", "text " * 60, "2026-06-28T00:00:00Z", "s", "rss", i) for i in range(12)], "title string, url string, content string, published_date string, source string, source_type string, pos int")
    none = spark.createDataFrame([], "id long, url string, title string, source string, published_at timestamp")
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    from newsmill.models import hashed_embedding

    for f in (True, False):
        model = fake(f)
        model.embed = hashed_embedding
        run = lambda: articles_run.run(fetched, none, none.select("url"), datetime(2026, 6, 29), model=model, book=book, pause=0.01)[0].collect()
        if f:
            with pytest.raises(Exception):
                run()
            before = told(log, "summary")
        else:
            got = run()
    assert [(r.title, r.summary, r.score) for r in sorted(got, key=lambda r: r.id)][:2] == [("Better title 0", "s", 90), ("Better title 1", "s", 90)] and len(got) == 12
    assert told(log, "score") == sorted(f"https://h.x/{i}" for i in range(12))  # once, in both runs together
    assert len(told(log, "summary")) == 12 and len(before) < 12


def test_failed_chunks_wait_for_the_next_run(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")

    def call(bad):
        def f(part):
            if bad and "t3" in set(part.text):
                raise ValueError("no")
            return pd.DataFrame({"n": [len(x) for x in part.text]})

        return f

    got = book.ask(rows(spark, 12), "n", ["text"], call(True), "n int", chunk=1, attempts=1, on_error="keep")
    assert {r.text for r in got.where("n is null").collect()} == {"t3"}
    assert book.ask(rows(spark, 12), "n", ["text"], call(False), "n int", chunk=1).where("n is null").count() == 0


def test_retries_pause(spark):
    slept, calls = [], []

    def call(part):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "answer"

    assert ledger.tried(call, None, 3, 2.0, slept.append) == "answer" and slept == [2.0, 4.0]
    calls.clear()
    with pytest.raises(OSError):
        ledger.tried(call, None, 2, 2.0, slept.append)


def test_pause_between_calls(spark, tmp_path):
    import time

    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    began = time.time()
    book.ask(rows(spark, 12), "slow", ["text"], lambda p: pd.DataFrame({"n": [1] * len(p)}), "n int", chunk=2, pause=0.5, tasks=1)
    assert time.time() - began >= 1.0  # three calls, two pauses


def test_embedder_loads_once_and_sees_each_text_once(spark, tmp_path):
    log, book = str(tmp_path), ledger.Ledger(spark, f"file://{tmp_path}/ledger")

    def load():
        note(log, "loaded", os.getpid())

        def model(part):
            note(log, "embedded", *part.text)
            return pd.DataFrame({"embedding": [[float(len(x)), 1.0] for x in part.text]})

        return model

    df = rows(spark, 60, 4).unionByName(spark.createDataFrame([(99, None)], "id long, text string"))
    got = {r.id: r.embedding for r in ledger.embed(book, df, f"m-{tmp_path.name}", load, chunk=2).collect()}
    assert got[0] == [2.0, 1.0] and got[59] == [3.0, 1.0] and got[99] is None and len(got) == 61
    workers = told(log, "loaded")
    assert len(workers) == len(set(workers)) and told(log, "embedded") == sorted(f"t{i}" for i in range(30))
    ledger.embed(book, df, f"m-{tmp_path.name}", load, chunk=2).count()
    assert len(told(log, "embedded")) == 30


def test_response_sink(spark, tmp_path):
    spark.dataSource.register(responses.ResponseSink)
    rows_ = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "id int, title string")
    page = responses.response(rows_.orderBy("id").limit(2), rows_.agg(F.count("*").alias("count")), "id")

    def write(df, mode="append", request="r1"):
        df.write.format("responses").mode(mode).option("path", f"file://{tmp_path}/out").option("request", request).save()

    def read(request="r1"):
        return [json.load(open(f)) for f in sorted(glob.glob(f"{tmp_path}/out/{request}/*.json"))]

    write(page)
    want = {"data": [{"id": 1, "title": "a"}, {"id": 2, "title": "b"}], "count": 3}
    assert read() == [want]
    write(page.withColumn("count", F.lit(9).cast("long")))  # the request is there: nothing changes, nothing is left
    assert read() == [want] and not os.listdir(f"{tmp_path}/out/_drafts")
    write(page.withColumn("count", F.lit(9).cast("long")), "overwrite")
    assert read()[0]["count"] == 9
    broken = page.unionByName(page).repartition(2).withColumn("count", F.when(F.spark_partition_id() == 1, F.raise_error(F.lit("no"))).otherwise(F.col("count")).cast("long"))
    with pytest.raises(Exception):
        write(broken, request="r2")
    assert read("r2") == [] and not os.path.exists(f"{tmp_path}/out/r2")
    write(responses.response(rows_.limit(0), rows_.limit(0).agg(F.count("*").alias("count")), "id"), request="r3")
    assert read("r3") == [{"data": [], "count": 0}]


def test_as_json_and_of_size(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0], "x")], "id int, v array<double>, t string")
    assert [json.loads(r.json) for r in feed.as_json(df).orderBy("json").collect()] == [{"id": 1, "v": [1.0, 2.0]}, {"id": 2, "v": [1.0], "t": "x"}]
    assert [r.v for r in df.orderBy("id").select(vectors.of_size(F.col("v"), 2).alias("v")).collect()] == [[1.0, 2.0], None]


def test_discovery_by_a_model(spark, tmp_path):
    from newsmill.operators import discover

    log = str(tmp_path)

    class Fake:
        def classify_profiles(self, part):
            note(log, "profiles", *part.handle)
            out = part[part.handle != "silent"]
            return pd.DataFrame({"handle": out.handle, "related": out.name.str.contains("AI"), "confidence": [140 if "AI" in n else 10 for n in out.name]})

        def extract_links(self, part):
            if "bad" in part.html.iloc[0]:
                raise ValueError("no")
            return pd.DataFrame({"id": part.id, "links": [[{"url": "https://github.com/a/b?utm_source=x", "text": "t"}]] * len(part)})

        def extract_products(self, part):
            return pd.DataFrame({"id": part.id, "products": [[{"name": w, "description": f"about {w}"} for w in t.split()] for t in part.text]})

        def select_products(self, part):
            return pd.DataFrame({"id": part.id, "numbers": [[2, 9]] * len(part)})

        def select_link(self, part):
            if part.name.iloc[0] == "fails":
                raise ValueError("no")
            return pd.DataFrame({"id": part.id, "number": [7 if n == "far" else 2 for n in part["name"]], "confidence": [0.4 if n == "weak" else 3.0 for n in part["name"]]})

    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    profiles = spark.createDataFrame([("a", "AI weekly", "x"), ("b", "Gardens", None), ("silent", "AI", ""), (None, "AI", "")], "handle string, name string, description string")
    for kept_in in (None, book, book):
        got = discover.classified(profiles, Fake(), kept_in)
        assert sorted((r.handle or "", r.related, r.confidence) for r in got.collect()) == [("", None, None), ("a", True, 100), ("b", False, 10), ("silent", None, None)]
        assert [r.handle for r in discover.relevant(got).collect()] == ["a"]
    assert told(log, "profiles").count("a") <= 3  # the ledger's second run asked nothing
    pages = spark.createDataFrame([(1, "<p>x", "one two three"), (2, "<p>bad", "")], "id long, html string, text string")
    got = {r.id: r.links for r in discover.links_by_model(pages, Fake(), book, attempts=1).collect()}
    assert [tuple(x) for x in got[1]] == [("https://github.com/a/b", "github", "t")] and got[2] == []
    got = {r.id: ([p.name for p in r.products], [p.name for p in r.kept]) for r in discover.products_by_model(pages, Fake(), book).collect()}
    assert got == {1: (["one", "two", "three"], ["two"]), 2: ([], [])}
    found = [{"url": "https://s.example", "text": "x"}, {"url": "https://own.example", "text": "y"}]
    rows_ = spark.createDataFrame([(i, n, "d", found) for i, n in enumerate(["good", "weak", "far", "fails"])], "id long, name string, description string, candidates array<struct<url:string,text:string>>")
    got = {r.name: (r.number, r.confidence, r.url) for r in discover.link_by_model(rows_, Fake(), book, least=0.5, attempts=1).collect()}
    assert got == {"good": (2, 1.0, "https://own.example"), "weak": (0, 0.0, None), "far": (0, 0.0, None), "fails": (0, 0.0, None)}
