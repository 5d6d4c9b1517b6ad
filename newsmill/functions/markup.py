"""HTML and feed functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .entities import unescape
from .text import whitespace_norm

# What links, bold texts, list entries and sections look like, limits of the recap extraction, the order of link classes.
LINK = r'<a[^>]+href="([^"]+)"[^>]*>([\s\S]*?)</a>'
POST_LINK = r'<a[^>]+href="(https?://(?:www\.)?reddit\.com/r/[^"]+/comments/[^"]+)"[^>]*>([\s\S]*?)</a>'
BOLD, ENTRY = r"<strong[^>]*>([\s\S]*?)</strong>", r"<li>([\s\S]*?)</li>"
CDATA = r"^<!\[CDATA\[([\s\S]*)\]\]>$"
CONTENT_LENGTH, BODY_LENGTH, TITLE_LENGTH = 1400, 120, 10
PRIORITY = ("github", "huggingface", "arxiv", "blog", "reddit", "tweet")


def strip_tags(c: Column) -> Column:
    return whitespace_norm(F.regexp_replace(c, r"<[^>]+>", " "))


def first_bold(c: Column) -> Column:
    return strip_tags(F.regexp_extract(c, BOLD, 1))


def pick_tag(c: Column, tag: str) -> Column:
    """The body of the first such tag without attributes; unwrapped if it is one CDATA section; empty if there is none."""
    body = F.coalesce(F.regexp_extract(c, rf"<{re.escape(tag)}>([\s\S]*?)</{re.escape(tag)}>", 1), F.lit(""))
    return F.when(body.rlike(CDATA), F.regexp_extract(body, CDATA, 1)).otherwise(body)


def feed_items(xml: Column) -> Column:
    """title, link, content_html, pub_date of a feed's items; only the content is entity-decoded (by the caller, see decoded)."""
    parts = F.split(xml, "<item>", -1)
    bodies = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.element_at(F.split(p, "</item>", 2), 1))
    return F.transform(
        bodies,
        lambda b: F.struct(
            pick_tag(b, "title").alias("title"), pick_tag(b, "link").alias("link"), pick_tag(b, "content:encoded").alias("content_html"), pick_tag(b, "pubDate").alias("pub_date")
        ),
    )


def collect_links(c: Column) -> Column:
    """url, host, text of the links with a double-quoted target."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(LINK), F.lit(1)).alias("url"), F.regexp_extract_all(c, F.lit(LINK), F.lit(2)).alias("body"))
    return F.transform(pairs, lambda p: F.struct(p["url"].alias("url"), urls.host_of(p["url"]).alias("host"), strip_tags(p["body"]).alias("text")))


def pick_primary(links: Column) -> Column:
    """url and kind of the best link: the first of the first class in PRIORITY that occurs, else the first that isn't junk, else ''."""
    clean = F.filter(links, lambda x: ~urls.is_junk(x["url"], x["host"]))
    rank = lambda h: F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), urls.classify_host(h)).cast("int"), F.lit(len(PRIORITY) + 1))
    ranked = F.transform(clean, lambda x, i: F.struct(rank(x["host"]).alias("rank"), i.alias("i"), x["url"].alias("url")))
    best = F.array_min(ranked)
    kinds = F.array(*[F.lit(p) for p in (*PRIORITY, "other")])
    return F.struct(F.coalesce(best["url"], F.lit("")).alias("url"), F.coalesce(F.get(kinds, best["rank"] - 1), F.lit("other")).alias("kind"))


def slice_section(c: Column, heading: str) -> Column:
    """What follows the first-level heading up to the next one; empty if there is no such heading."""
    return F.coalesce(F.regexp_extract(c, rf"(?is)<h1[^>]*>\s*{re.escape(heading)}\s*</h1>(.*?)(?=<h1[^>]*>|\z)", 1), F.lit(""))


def bullets(c: Column, n: int = 3) -> Column:
    found = F.regexp_extract_all(c, F.lit(ENTRY), F.lit(1))
    return F.array_join(F.transform(F.slice(found, 1, n), strip_tags), " ")


def post_recap(c: Column) -> Column:
    """title, url, content of the posts section; null if it lacks a section, a title of TITLE_LENGTH or a link."""
    region = slice_section(c, "AI Twitter Recap")
    title, primary = first_bold(region), pick_primary(collect_links(region))
    content = F.coalesce(F.nullif(bullets(region), F.lit("")), strip_tags(region))
    ok = (region != "") & (F.length(title) >= TITLE_LENGTH) & (primary["url"] != "")
    return F.when(ok, F.struct(title.alias("title"), primary["url"].alias("url"), F.substring(content, 1, CONTENT_LENGTH).alias("content")))


def thread_segments(c: Column) -> Column:
    """The threads section cut at its thread links; a segment ends at the next such link or at a heading inside it."""
    region = slice_section(c, "AI Reddit Recap")
    parts = F.split(region, f"(?={POST_LINK})", -1)  # groups don't matter in a split
    mine = F.filter(parts, lambda p: p.rlike(f"^{POST_LINK}"))
    cut = rf"(?is)^({POST_LINK}.*?)(?=<h[123][^>]*>|\z)"
    return F.transform(mine, lambda p: F.regexp_extract(p, cut, 1))


def thread_recap(c: Column) -> Column:
    """title, url, content of each thread whose text has BODY_LENGTH characters."""

    def story(s: Column) -> Column:
        primary = pick_primary(collect_links(s))
        title = F.coalesce(F.nullif(strip_tags(F.regexp_extract(s, f"^{POST_LINK}", 2)), F.lit("")), F.lit("(untitled)"))
        url = F.coalesce(F.nullif(primary["url"], F.lit("")), F.regexp_extract(s, f"^{POST_LINK}", 1))
        return F.struct(title.alias("title"), url.alias("url"), F.substring(strip_tags(s), 1, CONTENT_LENGTH).alias("content"))

    return F.transform(F.filter(thread_segments(c), lambda s: F.length(strip_tags(s)) >= BODY_LENGTH), story)


def decoded(c: Column) -> Column:
    return unescape(c)


# --- main text ---------------------------------------------------------------------------------------

#: Elements that hold no main text, and tags that end a block.
NO_TEXT = ("script", "style", "head", "nav", "header", "footer", "aside", "form", "table", "noscript", "template", "svg", "button", "select", "iframe")
BLOCK_TAG = r"(?i)</?(?:p|div|section|article|main|h[1-6]|ul|ol|li|dl|dt|dd|blockquote|pre|figure|figcaption|hr|address|details|summary|body|html)(?:\s[^>]*)?/?>"
ANCHOR = r"(?is)<a(?:\s[^>]*)?>(.*?)</a\s*>"
# Fixed values of the published tree over numbers of words and link density (Kohlschuetter, Fankhauser, Nejdl 2010).
LINKS, LINKS_BEFORE, WORDS, WORDS_AFTER, WORDS_BEFORE, WORDS_AFTER_LINKS, NEXT_AFTER_LINKS = 1 / 3, 5 / 9, 16, 15, 4, 40, 17


def _once(value: Column, use) -> Column:
    """``use(value)`` in which the value is made once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def main_part(c: Column) -> Column:
    """The page without comments and elements of no text, cut to its first article or main element if there is one (text); and whether there is
    (explicit)."""
    body = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    for tag in NO_TEXT:
        body = F.regexp_replace(body, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    both = _once(body, lambda b: F.struct(b.alias("body"), F.regexp_extract(b, r"(?is)<(article|main)(?:\s[^>]*)?>(.*?)</\1\s*>", 2).alias("inner")))
    return _once(both, lambda x: F.struct(F.when(x["inner"] != "", x["inner"]).otherwise(x["body"]).alias("text"), (x["inner"] != "").alias("explicit")))


def text_blocks(part: Column) -> Column:
    """text, words and linked (words inside of links) of each block of a page that has a text, in page order."""
    plain = lambda b: whitespace_norm(_once(F.regexp_replace(b, r"<[^>]*>", " "), unescape))
    count = lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
    linked = lambda b: plain(F.array_join(F.regexp_extract_all(b, F.lit(ANCHOR), F.lit(1)), " "))
    texts = F.transform(F.split(part, BLOCK_TAG, -1), lambda b: F.struct(plain(b).alias("text"), linked(b).alias("links")))
    return F.transform(F.filter(texts, lambda x: x["text"] != ""), lambda x: F.struct(x["text"].alias("text"), count(x["text"]).alias("words"), count(x["links"]).alias("linked")))


def _content(blocks: Column) -> Column:
    """Whether each block is main text by its and its neighbours' numbers of words and link densities."""
    density = lambda x: F.coalesce(x["linked"] / x["words"], F.lit(0.0))
    words = lambda x: F.coalesce(x["words"], F.lit(0))

    def one(x: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        plainly = (words(x) > WORDS) | (words(after) > WORDS_AFTER) | (words(before) > WORDS_BEFORE)
        after_links = (words(x) > WORDS_AFTER_LINKS) | (words(after) > NEXT_AFTER_LINKS)
        return (density(x) <= LINKS) & F.when(density(before) <= LINKS_BEFORE, plainly).otherwise(after_links)

    return F.transform(blocks, one)


def _fused(blocks: Column, content: Column) -> Column:
    """A block with few links between two blocks of main text is main text as well."""
    at = lambda i: F.coalesce(F.get(content, i), F.lit(False))
    return F.transform(blocks, lambda x, i: at(i) | (at(i - 1) & at(i + 1) & (x["linked"] / x["words"] <= LINKS)))


def main_text(c: Column, limit: int | None = None) -> Column:
    """The text of a page's main part, a line for each block: in an article or main element all blocks of which no more than half is linked, else those
    that block scoring takes. Text that is too short or a wall is empty; ``limit`` cuts to so many code points."""
    from .text import is_blocker

    def kept(part: Column) -> Column:
        scored = _once(text_blocks(part["text"]), lambda b: F.struct(b.alias("blocks"), _content(b).alias("content")))
        fused = _once(scored, lambda s: F.struct(s["blocks"].alias("blocks"), _fused(s["blocks"], s["content"]).alias("content")))
        taken = lambda s: F.filter(s["blocks"], lambda x, i: F.when(part["explicit"], 2 * x["linked"] <= x["words"]).otherwise(F.get(s["content"], i)))
        return F.array_join(F.transform(_once(fused, taken), lambda x: x["text"]), "\n")

    text = _once(_once(main_part(F.coalesce(c, F.lit(""))), kept), lambda t: F.when(is_blocker(t), "").otherwise(t))
    return F.substring(text, 1, limit) if limit else text
