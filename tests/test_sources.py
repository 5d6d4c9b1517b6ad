import json
from datetime import datetime

from pyspark.sql import functions as F

from newsmill import schema
from newsmill.sources import pages, snapshots
from newsmill.streaming.admission import admit

AS_OF = datetime(2026, 6, 29)


def test_hacker_news(spark):
    top = spark.createDataFrame([([3, 1, 2, 9, 5],)], "ids array<bigint>")
    at = int(datetime(2026, 6, 28).timestamp())
    items = spark.createDataFrame(
        [(1, "story", "Show HN: an LLM thing", "", at), (2, "story", "Gardening", "https://g", at), (3, "story", "GPT news", "https://n", None), (5, "job", "AI job", "https://j", at), (4, "story", "AI", "https://late", at)],
        schema.HN_ITEM,
    )
    got = snapshots.hacker_news(top, items, AS_OF).orderBy("pos").collect()
    assert [(r.title, r.url) for r in got] == [("GPT news", "https://n"), ("an LLM thing", "https://news.ycombinator.com/item?id=1")]
    assert got[0].published_date.startswith("2026-06-29")


FEED = """<rss><item><title>Big &amp; news</title><link>l</link><pubDate>Mon, 29 Jun 2026 00:00:00 GMT</pubDate>
<content:encoded><![CDATA[{html}]]></content:encoded></item>
<item><title>not much happened today</title><pubDate></pubDate><content:encoded>x</content:encoded></item>
<item><title>Old</title><pubDate>Mon, 01 Jun 2026 00:00:00 GMT</pubDate><content:encoded>x</content:encoded></item></rss>"""
BODY = "long enough body text " * 8
HTML = (
    "<h1>AI Twitter Recap</h1><p><strong>A title that is long</strong></p><ul><li>one <b>b</b></li><li>two</li><li>three</li><li>four</li></ul>"
    '<a href="https://x.com/p">x</a> <a href="https://github.com/a/b">g</a>'
    '<H1>AI Reddit Recap</H1><a href="https://www.reddit.com/r/a/comments/1">First &amp; best</a>' + BODY + '<a href="https://huggingface.co/m">m</a>'
    '<a href="https://reddit.com/r/a/comments/2">short</a> tiny<a href="https://reddit.com/r/a/comments/3"></a>' + BODY + "<h2>Other</h2> gone"
)


def test_recap_feed(spark):
    xml = spark.createDataFrame([(FEED.format(html=HTML),)], "xml string")
    got = snapshots.recap_feed(xml, AS_OF).orderBy("pos").collect()
    assert [r.url for r in got] == ["https://github.com/a/b", "https://huggingface.co/m", "https://reddit.com/r/a/comments/3"]
    assert got[0].title == "A title that is long" and got[0].content == "one b two three"
    assert got[1].title == "First & best" and got[2].title == "(untitled)"
    assert "gone" not in got[2].content and "tiny" not in got[1].content


def test_newsletters_and_union(spark):
    e = spark.createDataFrame([("", "", "", "", "2026-06-28", "N", 0, 0), ("t", "u", "s", "2026-05-01", "", "N", 0, 1), ("t", "u", None, None, None, "N", 1, 0)], schema.FEED_ENTRY + ", name string, feed int, entry int")
    got = snapshots.newsletter_feeds(e, AS_OF).orderBy("pos").collect()
    assert [(r.title, r.url, r.published_date) for r in got] == [("(no title)", "", "2026-06-28"), ("t", "u", "")]
    f = snapshots.newsletter_feeds(e, AS_OF)
    assert snapshots.union(f, f).select("rank").distinct().count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "a", "rssUrl": "b"}]))
    assert snapshots.registry(spark, str(tmp_path / "r.json")).collect() == [("a", "b")]
    rows = [{"id": 1, "score": 5, "summary": "s", "published_at": "2026-06-29T00:00:00Z"}, {"id": 2, "score": 5, "summary": "", "published_at": "bad"}]
    (tmp_path / "e.json").write_text(json.dumps(rows))
    got = snapshots.export(spark, str(tmp_path / "e.json")).orderBy("id").collect()
    assert [(r.complete, r.published_at is None) for r in got] == [(True, False), (False, True)]


def test_page_source(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>hi</p>")
    spark.dataSource.register(pages.PageSource)
    df = spark.read.format("pages").option("list", f"file://{tmp_path}/a.html\nfile://{tmp_path}/none").option("slices", "2").load()
    got = {r.url[-4:]: r for r in df.collect()}
    assert got["html"].body == "<p>hi</p>" and got["none"].body is None and got["none"].error


def test_retries():
    import urllib.error

    seen, slept = [], []

    def opener(url, timeout):
        seen.append(url)
        raise urllib.error.HTTPError(url, 429, "slow down", {}, None)

    assert pages.fetch("u", "http://p", opener, slept.append)[1] == 429
    assert len(seen) == 3 and slept == [2.0, 4.0]
    assert pages.fetch("u", None, opener, slept.append)[1] == 429 and len(seen) == 4


def test_admission_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "url string, pos int").write.parquet(src)

    def go():
        s = spark.readStream.schema("url string, pos int").parquet(src)
        admit(s, out, f"{tmp_path}/cp").awaitTermination()
        return sorted((r.url, r.pos) for r in spark.read.parquet(out).collect())

    assert go() == [("a", 1), ("b", 2)]
    spark.createDataFrame([("b", 5), ("c", 6)], "url string, pos int").write.mode("append").parquet(src)
    assert go() == [("a", 1), ("b", 2), ("c", 6)]


def test_windowed_counts_batch(spark):
    from newsmill.streaming.admission import windowed_counts

    e = spark.createDataFrame([(datetime(2026, 1, 1, 0, 5), "a"), (datetime(2026, 1, 1, 0, 55), "a"), (datetime(2026, 1, 1, 1), "a")], "ts timestamp, k string")
    assert sorted(r.n for r in windowed_counts(e, "ts", "k").select(F.col("n")).collect()) == [1, 2]


def test_append_import_and_reload(spark, tmp_path):
    import json

    from newsmill.sources import sinks

    rows = [
        {"id": 7, "title": "T", "source": "s", "source_type": "rss", "url": "u7", "published_at": "2026-06-29T10:00:00Z", "score": 5, "summary": "S", "categories": ["dev"], "kind": "blog", "content": "c", "created_at": "bad"},
        {"id": 3, "title": "U", "source": "s", "source_type": "rss", "url": None, "score": None, "summary": "x"},
    ]
    (tmp_path / "export.json").write_text(json.dumps(rows))
    path = str(tmp_path / "articles")
    sinks.import_export(spark, str(tmp_path / "export.json"), path)
    sinks.import_export(spark, str(tmp_path / "export.json"), path)
    got = spark.read.parquet(path).orderBy("id").collect()
    assert [(r.id, r.export_id) for r in got] == [(1, 3), (2, 7), (3, 3), (4, 7)]
    assert [r.embedding is None for r in got] == [True, False] * 2 and len(got[1].embedding) == 256
    assert (got[0].content, got[0].categories, got[1].created_at) == ("", [], None) and got[1].published_at == datetime(2026, 6, 29, 10)
    sinks.reload(path, spark.range(2))
    assert spark.read.parquet(path).count() == 2


def test_sample_articles(spark):
    from newsmill.sources import sinks

    at = datetime(2026, 6, 29)
    rows = sinks.sample_articles(spark, at, seed=4).collect()
    assert rows == sinks.sample_articles(spark, at, seed=4).collect() != sinks.sample_articles(spark, at, seed=5).collect()
    ages = [(at - r.published_at).total_seconds() / 86400 for r in rows]
    assert all(0 <= a <= 7 for a in ages[:40]) and all(7 <= a <= 30 for a in ages[40:48]) and all(31 <= a <= 40 for a in ages[48:])
    assert all(1 <= r.score <= 10 and 1 <= len(set(r.categories)) == len(r.categories) <= 2 for r in rows)
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-4 and len(r.embedding) == 256 for r in rows)
    assert len({r.kind for r in rows}) == 6 and len({r.source for r in rows}) == 5


def test_fetch_pages(spark):
    import io

    from newsmill.sources import pages

    class Answer(io.BytesIO):
        status = 200
        headers = {"Content-Type": "text/html"}

    def opener(url, timeout):
        if "bad" in url:
            raise OSError("no route")
        return Answer(f"<p>{url}</p>".encode())

    wanted = spark.createDataFrame([("https://a.b/1",), ("https://a.b/1",), ("https://bad.b/",), ("https://x.com/p",), ("https://[bad",)], "url string")
    got = {r.url: (r.status, r.body, r.error) for r in pages.fetch_pages(wanted, opener=opener).collect()}
    assert got == {"https://a.b/1": (200, "<p>https://a.b/1</p>", None), "https://bad.b/": (None, None, "no route")}
    html = {r.url: r.html for r in pages.html_of(wanted, pages.fetch_pages(wanted, opener=opener)).collect()}
    assert html == {"https://a.b/1": "<p>https://a.b/1</p>", "https://bad.b/": "", "https://x.com/p": "", "https://[bad": ""}
