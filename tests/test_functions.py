from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newsmill.functions import dates, markup, text, urls, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "f, given, want",
    [
        (text.clean_title, "Show HN: Foo", "Foo"),
        (text.clean_title, "ask hn:   Bar ", "Bar"),
        (text.clean_title, None, None),
        (text.strip_wrappers, '[HN] 1. "Foo bar"', "Foo bar"),
        (text.strip_wrappers, '"', '"'),
        (text.strip_wrappers, '""Foo""', '"Foo"'),
        (text.sanitize, "“Hi” – it’s → ok…  🚀", '"Hi" - it\'s -> ok...'),
        (text.sanitize, "a\n\nb", "a\n\nb"),
        (text.sanitize, "▪ x", "- x"),
        (text.initials, "ada lovelace byron", "AL"),
        (text.whitespace_norm, " a \t\n b\x1c", "a b"),
        (text.unescape, "a &amp; b&#39;s", "a & b's"),
        (urls.kind_from_url, "https://www.github.com/a/b", "repo"),
        (urls.kind_from_url, "https://gist.github.com/a", None),
        (urls.kind_from_url, "https://hf.co/x", "model"),
        (urls.kind_from_url, "https://arxiv.org/abs/1", "paper"),
        (urls.repo_from_text, "see https://github.com/features/actions and https://github.com/a/b", None),
        (urls.repo_from_text, "code: http://github.com/a/b.", "https://github.com/a/b."),
        (urls.skip_domain, "https://mobile.x.com/a", True),
        (urls.skip_domain, "https://netflix.com/a", False),
        (urls.skip_domain, "https://[bad/a", True),
        (text.sanitize, "plain  text ", "plain text"),
        (text.sanitize, "a👩‍🚀b©™ c", "ab c"),
        (urls.hostname, "HTTPS://user:p@Foo.com:8080/x", "foo.com"),
        (urls.strip_utm, "https://a.b/c?utm_source=x&y=1#z", "https://a.b/c?y=1#z"),
        (urls.strip_utm, "https://a.b/c?utm_source=x", "https://a.b/c"),
        (markup.strip_tags, "<p>a<b> b</b>\n</p>", "a b"),
        (markup.first_bold, "x<strong class=a>T <i>u</i></strong>", "T u"),
    ],
)
def test_golden(spark, f, given, want):
    assert one(spark, f(F.lit(given).cast("string"))) == want


def test_unescape_of_every_name_and_number(spark):
    import html
    import html.entities

    names = sorted(html.entities.html5)
    rows = [f"&{n}" for n in names] + [f"x&{n.rstrip(';')}y" for n in names] + [f"&{n}&{n[:-1]}&amp{n}" for n in names] + [f"&{n[: len(n) // 2 + 1]} &{n[:-1]}=" for n in names]
    low = list(range(0, 300)) + [n for n in range(300, 0x110010, 997)] + list(range(0xD7F0, 0xE010)) + [0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0] + [p * 0x10000 + x for p in range(17) for x in (0xFFFD, 0xFFFE, 0xFFFF)]
    rows += [f"&#{n};" for n in low] + [f"&#x{n:x};&#X{n:06X}" for n in low] + ["&#" + "9" * 60 + ";", "&#" + "0" * 60 + "65;", "&#;", "&#x;", "&", "&&", "&;", "a&b&c", "&" + "a" * 40, "&notit;&notin;&notin", "&\tx", None]
    got = spark.createDataFrame([(x,) for x in rows], "c string").repartition(8).select("c", text.unescape(F.col("c")).alias("u")).collect()
    wrong = [(x.c, x.u, html.unescape(x.c)) for x in got if x.c is not None and x.u != html.unescape(x.c)]
    assert not wrong, wrong[:5]
    assert all(x.u is None for x in got if x.c is None)


_WORDS = " ".join(f"word{i}" for i in range(45))
_MENU = "<div><a href='/a'>Home</a> <a href='/b'>About us</a></div>"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        (f"<article><p>{_WORDS}</p><p>Short end.</p></article><p>{_WORDS} outside</p>", f"{_WORDS}\nShort end."),
        (f"<main><p>{_WORDS}</p><p><a href=x>all linked words here</a></p></main>", _WORDS),
        (f"{_MENU}<div><p>{_WORDS}</p></div>", _WORDS),
        (f"{_MENU}<h2>A heading</h2><p>{_WORDS}</p><p>{_WORDS} again</p><p>Copyright us</p>", f"A heading\n{_WORDS}\n{_WORDS} again\nCopyright us"),
        (f"<p>Hi</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>{_WORDS}</p><ul><li><a href=3>three</a><li><a href=4>four</a></ul><p>Bye</p>", _WORDS),
        (f"<nav><p>{_WORDS}</p></nav><script>{_WORDS}</script><!-- {_WORDS} --><p>{_WORDS} kept</p><footer>{_WORDS}</footer>", f"{_WORDS} kept"),
        (f"<p>{_WORDS} &amp; &eacute;&nbsp;x</p>", f"{_WORDS} & é x"),
        (f"<div>Please sign in. {_WORDS}</div>", ""),
        ("<p>too short</p>", ""),
        (f"<p>{_WORDS}</p><p>few words</p><p>{_WORDS} more</p>", f"{_WORDS}\nfew words\n{_WORDS} more"),
        (f"<p>{_WORDS}</p><p>see <a href=x>a</a></p><p>{_WORDS} more</p>", f"{_WORDS}\n{_WORDS} more"),
        (f"<section><table><tr><td>{_WORDS}</td></tr></table><p>{_WORDS} b<br>c</p></section>", f"{_WORDS} b c"),
    ],
)
def test_main_text(spark, page, want):
    assert one(spark, markup.main_text(F.lit(page).cast("string"))) == want
    assert one(spark, markup.main_text(F.lit(page).cast("string"), 7)) == want[:7]


def test_unescape(spark):
    import html
    import random

    r = random.Random(1)
    parts = ["&amp;", "&lt;", "&", "amp;", "&#8217;", "&#x1F600;", "&#150;", "&#0;", "&#55555;", "&eacute;", "x", "é", "&nbsp;", ";", "&#9999999;", "&#38;lt;", "&#X41;", "&quot;"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1000)]
    got = spark.createDataFrame([(x,) for x in rows], "c string").select("c", text.unescape(F.col("c")).alias("u")).collect()
    assert all(x.u == html.unescape(x.c) for x in got)


@pytest.mark.parametrize(
    "title, hit",
    [("AI-powered editor", True), ("GPT-4 notes", True), ("Token bucket", True), ("A fine-tuning guide", False), ("artificial intelligence", False), ("Transformers explained", False), ("Email tips", False)],
)
def test_keywords(spark, title, hit):
    assert one(spark, text.keyword_match(F.lit(title))) is hit


@pytest.mark.parametrize(
    "host, kind", [("foo.github.io", "github"), ("old.reddit.com", "reddit"), ("x.com", "tweet"), ("foo.dev", "blog"), ("example.com", None), ("my.substack.com", "blog")]
)
def test_host_class(spark, host, kind):
    assert one(spark, urls.classify_host(F.lit(host))) == kind


def test_primary_link(spark):
    html = '<a href="https://x.com/a">t</a><a href="https://reddit.com/r">r</a><a href="https://github.com/a/b">g</a>'
    assert one(spark, markup.pick_primary(markup.collect_links(F.lit(html)))["url"]) == "https://github.com/a/b"
    junk = '<a href="https://x.com/i/1">t</a><a href="https://netflix.com/i/1">t</a>'
    got = spark.range(1).select(markup.pick_primary(markup.collect_links(F.lit(junk))).alias("p")).first().p
    assert (got.url, got.kind) == ("", "other")


def test_blockers(spark):
    assert one(spark, text.is_blocker(F.lit("clean prose " * 4)))
    assert not one(spark, text.is_blocker(F.lit("clean prose " * 5)))
    assert one(spark, text.is_blocker(F.lit("clean prose " * 5 + "Please log in")))
    assert one(spark, text.is_blocker(F.lit("clean prose " * 5 + "access\xa0denied")))


@pytest.mark.parametrize(
    "given, want",
    [
        ("Mon, 29 Jun 2026 10:00:00 GMT", datetime(2026, 6, 29, 10)),
        ("29 Jun 2026 10:00:00 +0200", datetime(2026, 6, 29, 8)),
        ("2026-06-29T10:00:00Z", datetime(2026, 6, 29, 10)),
        ("2026-06-29", datetime(2026, 6, 29)),
        ("29 June 2026 10:00 EST", datetime(2026, 6, 29, 15)),
        ("Mon, 29 Jun 26 10:00:05 PDT", datetime(2026, 6, 29, 17, 0, 5)),
        ("1 Jan 70 00:00:00 +0530", datetime(1969, 12, 31, 18, 30)),
        ("Mon, 29 Jun 2026 10:00:00 XYZ", datetime(2026, 6, 29, 10)),
        ("31 Feb 2026 10:00:00 GMT", None),
        ("garbage", None),
        ("2026", None),
        (None, None),
    ],
)
def test_parse(spark, given, want):
    assert one(spark, dates.parse(F.lit(given).cast("string")).cast("timestamp_ntz")) == want


def test_window(spark):
    as_of = datetime(2026, 6, 29)
    for ts, want in ((None, True), ("2026-06-22T00:00:00", True), ("2026-06-21T23:59:59", False), ("2030-01-01T00:00:00", True)):
        assert one(spark, dates.within_window(F.lit(ts).cast("timestamp"), as_of)) is want
    assert dates.since_or_default("nonsense", as_of) == dates.since_or_default(None, as_of) == datetime(2026, 5, 30)
    assert dates.since_or_default("2026-06-01T02:00:00+02:00", as_of) == datetime(2026, 6, 1)
    assert dates.preset_since("?", as_of) == datetime(2026, 6, 22)


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.norm(a)) == 5
    assert one(spark, vectors.normalise(a)) == [0.6, 0.8]
    assert one(spark, vectors.normalise(z)) == [0, 0]
    assert one(spark, vectors.cosine_distance(a, a)) == pytest.approx(0)
    assert one(spark, F.isnan(vectors.cosine_distance(a, z)))


def test_titles(spark):
    f = lambda new, old, s: one(spark, text.accept_title(F.lit(new), F.lit(old), F.lit(s)))
    assert f('"Better"', "Old", "Blog") == "Better"
    assert f("Better, by blog", "Old", "Blog") == "Old"
    assert f("", "Old", "Blog") == "Old"
