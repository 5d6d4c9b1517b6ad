"""Main text of web pages by site style trees: branches that all pages of a host share in form and in words are taken off each page.

Pages of a host are merged into one tree. An element node is known by its place: its parent, the row of tags and classes that it stands in (the
parent's style; a run of equal children counts once) and its position there. Over the pages that have the node, an element's importance
falls the fewer styles it shows, and a segment's the more pages hold its words; both are entropies in base m, the number of pages. An element's
composite importance adds its children's, by Yi, Liu and Li's rule: (1 - g) * own + g * (sum of the children's by the share of their style), with
g = 0.9 ** styles. A branch below ``least`` on ``pages`` pages or more is dropped from each page.

All sums are made by partial aggregation over (node, style or words), whatever a host's share of the pages; nodes that one page alone has
count as wholly important and never become rows of the tree. Pages whose main parts agree in a sketch (the least hash of three
successive words) count once for the words they share, so copies of an article aren't taken for a frame.

The tree is applied on top of what markup itself says (:mod:`page_tree`): menus, footers, asides, forms and what is named so go,
and an article or main element, where there is one, is the main part. In such an element headings, paragraphs, list items and the
like without a class of their own stay; headings of the first order always do. A branch with more than half of a page's text goes only if all that it
holds there, texts included, is below ``least`` too, and something else stays.

Odd input: null or empty pages have an empty text; pages without a host form one site; repeated rows give their text each; elements are judged
however deep they are nested. No rows give no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bitmap_of, drop_stored, in_bitmap, joined, pieces, small_batches, stored, windows
from .page_tree import DIGITS, Page

#: A shape's number of depths less two, a power of two that no page's nesting reaches, since a string has fewer bytes.
FOLD = (1 << 31) - 2
#: Bits of the bitmaps, as a power of two (16 MB), whatever the number of sites.
BITS = 27
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
TEXT = "#text"


def _h(s: str) -> int:
    """A signed 64-bit hash."""
    return (xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) ^ (1 << 63)) - (1 << 63)


def shaped(width: int, depth: int, text: bool) -> int:
    return (width * (FOLD + 2) + depth) * 2 + text


class Placed:
    """A page's nodes and segments by their places in the site's tree; parts that the markup sets aside are left out.

    ``place``: node -> id; ``rows``: id -> [parent's id, shape, runs, {style or words: times}], shape naming the number of children in the
    parent's style, the depth and whether it is text."""

    def __init__(self, page: Page, host: str):
        self.page = page
        nodes = page.nodes
        full = [False] * len(nodes)  # nodes with text below them
        for i in range(len(nodes) - 1, -1, -1):
            full[i] |= any(f < 0 for f in nodes[i].flow)
            if full[i] and i:
                full[nodes[i].parent] = True
        self.place, self.rows = {0: _h("site:" + host)}, {}
        self.rows[self.place[0]] = [0, shaped(1, 0, False), 1, {}]
        for i, n in enumerate(nodes):
            if i not in self.place:
                continue
            own, runs, members = self.place[i], [], []
            for f in n.flow:
                if f >= 0 and (not full[f] or nodes[f].aside):
                    continue
                key = TEXT if f < 0 else nodes[f].key
                if not runs or runs[-1] != key:
                    runs.append(key)
                    members.append([])
                members[-1].append(f)
            style = _h(">".join(runs))
            values = self.rows[own][3]
            values[style] = values.get(style, 0) + 1
            for at, (key, group) in enumerate(zip(runs, members)):
                child = _h(f"{own}:{style}:{at}:{key}")
                row = self.rows.get(child)
                if row is None:
                    row = self.rows[child] = [own, shaped(len(runs), n.level + 1, key == TEXT), 0, {}]
                row[2] += 1
                for f in group:
                    if f < 0:
                        words = _h(TEXT + DIGITS.sub("0", page.segments[~f][1]))
                        row[3][words] = row[3].get(words, 0) + 1
                    else:
                        self.place[f] = child

    def judged(self) -> dict[int, list[int]]:
        """id -> nodes that the tree may drop from this page, whatever their share of its text."""
        page, nodes = self.page, self.page.nodes
        self.size, held = [0] * len(nodes), [False] * len(nodes)
        for i, text in page.segments:
            if page.main[i] and not nodes[i].aside:
                self.size[i] += len(text)
        for i in range(len(nodes) - 1, 0, -1):
            held[i] |= nodes[i].tag == "h1"
            self.size[nodes[i].parent] += self.size[i]
            held[nodes[i].parent] |= held[i]
        out: dict[int, list[int]] = {}
        for i, place in self.place.items():
            n = nodes[i]
            if i and self.size[i] and not held[i] and not (page.explicit and n.key == n.tag and n.tag in PLAIN):
                out.setdefault(place, []).append(i)
        return out

    def dropped(self, low: set[int]) -> list[int]:
        """Nodes to drop from this page, of which ``low`` are the places of low importance, texts' too."""
        nodes = self.page.nodes
        whole = [i not in self.place or self.place[i] in low for i in range(len(nodes))]  # all that it holds is low
        texts = {row[0] for place, row in self.rows.items() if row[1] % 2 and place not in low}
        for i in range(len(nodes) - 1, 0, -1):
            if i in self.place:
                whole[i] &= self.place[i] not in texts
                whole[nodes[i].parent] &= whole[i]
        found = [i for place, at in self.judged().items() if place in low for i in at]
        small = [i for i in found if 2 * self.size[i] <= self.size[0]]
        most = [i for i in found if 2 * self.size[i] > self.size[0] and whole[i]]
        return small + most if most and self.page.blocks(small + most) else small


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][\w+.-]*:)?//([^/?#\\]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _placed(page, url) -> Placed:
    return Placed(Page(page), host_of(url))


def _pages(df: DataFrame, html_col: str, url_col: str) -> DataFrame:
    """(url, html, page): ``page`` names equal rows alike."""
    rows = df.select(F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return small_batches(rows, 200).withColumn("page", _page_key(F.col("url"), F.col("html")))


def _page_key(url: Column, html: Column) -> Column:
    return F.md5(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), html).cast("binary"))


# --- the tree of each site -----------------------------------------------------------------------


def _observed(pages: DataFrame) -> DataFrame:
    """(node, value, a, b, n): for each node of a page its place (value null: parent, shape, runs) and its styles or words (the page's
    sketch, whether the node's first, times)."""

    def run(batches):
        hashes = WordHashes()
        for b in pieces(batches, 200):
            cols: list[list] = [[], [], [], [], []]
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = _placed(source, url)
                w = windows(hashes.of(" ".join(p.page.blocks()).lower().encode("utf-8", "surrogatepass").split()), 3)
                sketch = int(w.min().astype(np.int64)) if len(w) else _h("\n".join(p.page.blocks()))
                for node, (parent, shape, runs, values) in p.rows.items():
                    if not values:
                        continue
                    for c, x in zip(cols, (node, None, parent, shape, runs)):
                        c.append(x)
                    for k, (value, times) in enumerate(values.items()):
                        for c, x in zip(cols, (node, value, sketch, k == 0, times)):
                            c.append(int(x))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "value", "a", "b", "n"])

    return pages.select("url", "html").mapInArrow(run, "node long, value long, a long, b long, n long")


def site_tree(pages: DataFrame) -> DataFrame:
    """Stored (node, parent, shape, runs, m, times, nlogn, logs, styles) of the nodes that several pages share: m pages, ``styles`` different
    styles or words that occur ``times`` times, sums of n log n over their times and of log n over the pages (of different sketches)."""
    values = _observed(pages).groupBy("node", "value").agg(F.min("a").alias("a"), F.max("a").alias("z"), F.max("b").alias("b"), F.sum("b").alias("first"), F.sum("n").alias("n"), F.count("*").alias("c"))
    held = F.col("value").isNotNull()
    seen = F.when(held, F.when(F.col("a") == F.col("z"), 1).otherwise(F.col("c")))
    facts = values.groupBy("node").agg(
        F.max(F.when(~held, F.col("a"))).alias("parent"),
        F.max(F.when(~held, F.col("b"))).alias("shape"),
        F.sum(F.when(~held, F.col("n"))).alias("runs"),
        F.sum(F.when(held, F.col("first"))).alias("m"),
        F.sum(F.when(held, F.col("n"))).alias("times"),
        F.sum(F.when(held, F.col("n") * F.log("n"))).alias("nlogn"),
        F.sum(F.when(held, F.log(seen))).alias("logs"),
        F.sum(held.cast("long")).alias("styles"),
    )
    return stored(facts.where("m > 1"), "site-tree")


def importances(tree: DataFrame, decay: float = 0.9) -> DataFrame:
    """Stored (node, m, text, lacks): what each node of the tree lacks of a composite importance of 1. Nodes that aren't in the tree lack nothing.

    Each node passes on what it lacks to its parent, by its share. In each round a node takes in what its descendants ``up`` to it have
    summed, and looks twice as far up from then on, so rounds grow with the logarithm of the depth."""
    log_m = F.log("m")
    apart = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log("times") - F.col("nlogn") / F.col("times")) / log_m))
    g, text = F.pow(F.lit(decay), "styles"), F.col("shape") % 2 == 1
    own = F.when(text, F.col("logs") / F.col("styles") / log_m).otherwise((1 - g) * (1 - apart))
    width = F.floor(F.shiftright("shape", 1) / (FOLD + 2))
    nodes = tree.select("node", F.col("parent").alias("up"), "m", text.alias("text"), own.alias("lacks"), (F.col("runs") / width).alias("share"))
    holders = tree.select(F.col("node").alias("up"), F.col("node").alias("holder"), (g / F.col("times")).alias("given"))
    at = joined(nodes, holders, "up", ["node"], "left").select("node", "m", "text", "lacks", F.col("holder").alias("up"), (F.col("share") * F.col("given")).alias("share"))
    at = stored(at, "site-importance")
    while not (rising := at.where("up is not null")).isEmpty():
        taken = rising.groupBy(F.col("up").alias("node")).agg(F.sum(F.col("share") * F.col("lacks")).alias("taken"))
        further = rising.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("share").alias("next_share"))
        summed = at.join(taken, "node", "left").withColumn("lacks", F.col("lacks") + F.coalesce("taken", F.lit(0.0))).drop("taken")
        rises = joined(summed, further, "up", ["node"], "left")
        last, at = at, stored(rises.select("node", "m", "text", "lacks", F.col("next").alias("up"), (F.col("share") * F.col("next_share")).alias("share")), "site-importance")
        drop_stored(last)
    return at.select("node", "m", "text", "lacks")


def low_nodes(tree: DataFrame, least: float, pages: int) -> DataFrame:
    """Stored (node, text) of the tree's nodes, texts too, whose composite importance is below ``least`` and that ``pages`` pages have."""
    found = importances(tree)
    low = stored(found.where((F.col("lacks") > 1 - least) & (F.col("m") >= pages)).select("node", "text"), "site-low")
    drop_stored(found)
    return low


def low_branches(tree: DataFrame, least: float, pages: int) -> DataFrame:
    """(node) of the branches among :func:`low_nodes`."""
    return low_nodes(tree, least, pages).where("not text").select("node")


# --- extraction ----------------------------------------------------------------------------------


def _dropped(pages: DataFrame, low: DataFrame) -> DataFrame:
    """Stored (key, nodes): for pages that have low branches, the places of theirs that are in ``low`` (node, text), which is stored."""
    bitmap = pages.sparkSession.sparkContext.broadcast(bitmap_of(low.select("node"), "node", BITS))

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in pieces(batches, 200):
            keys, ids = [], []
            for key, url, source in zip(*(c.to_pylist() for c in b.columns)):
                p = _placed(source, url)
                may = lambda places: np.array(places, np.int64)[in_bitmap(bits, BITS, np.array(places, np.int64).view(np.uint64))]
                if len(may(list(p.judged()))):
                    found = may(list(p.rows)).tolist()
                    keys += [key] * len(found)
                    ids += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64())], names=["key", "node"])

    hits = pages.select(F.col("page").alias("key"), "url", "html").mapInArrow(run, "key string, node long")
    hits = stored(hits, "site-hits")
    sure = joined(hits, low.select("node").distinct(), "node", ["key"]).dropDuplicates(["key", "node"])  # pages repeated as rows drop the same nodes
    out = stored(sure.groupBy("key").agg(F.collect_list("node").alias("nodes")), "site-dropped")
    drop_stored(hits)
    return out


def _texts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``text``, from html, url and the page's places of low importance."""

    def text_of(source, url, low):
        page = Page(source)
        return "\n".join(page.blocks(Placed(page, host_of(url)).dropped(set(low)) if low else ()))

    def run(batches):
        for b in pieces(batches, 200):
            out = [text_of(*x) for x in zip(*(b.column(c).to_pylist() for c in ("html", "url", "low")))]
            yield b.select(keep).append_column("text", pa.array(out, pa.string()))

    schema = rows.select(*keep).withColumn("text", F.lit("")).schema
    return rows.mapInArrow(run, schema)


def main_texts(df: DataFrame, html_col: str, url_col: str, keep: list[str], least: float = 0.2, pages: int = 3) -> DataFrame:
    """``keep`` columns of every row with ``text``, the blocks of the page's main part in page order, joined by newlines.

    Pages whose tree drops nothing are read in place; only those with a branch to drop are joined with their lists, which needs a shuffle of their html.
    """
    tree = site_tree(_pages(df, html_col, url_col))
    low = low_nodes(tree, least, pages)
    drop_stored(tree)
    html_of = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    names = [f"k{i}" for i in range(len(keep))]
    rows = small_batches(df, 200).select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], html_of.alias("html"), F.col(f"`{url_col}`").alias("url"))
    back = lambda t: t.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "text")
    none = F.lit(None).cast("array<long>").alias("low")
    if low.where("not text").isEmpty():
        drop_stored(low)
        return back(_texts(rows.select(*names, "html", "url", none), names))
    lists = _dropped(_pages(df, html_col, url_col), low)
    drop_stored(low)
    rows = rows.withColumn("key", _page_key(F.col("url"), F.col("html")))
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(lists.select(F.xxhash64("key").alias("h")), "h", BITS))
    marked = rows.select("*", F.xxhash64("key").alias("h"))

    def pick(wanted: bool) -> DataFrame:
        def run(batches):
            bits = np.frombuffer(bitmap.value, np.uint8)
            for b in batches:
                hit = in_bitmap(bits, BITS, b.column(b.num_columns - 1).to_numpy().view(np.uint64))
                yield b.select(range(b.num_columns - 1)).filter(pa.array(hit == wanted))

        return marked.mapInArrow(run, rows.schema)

    listed = joined(pick(True), lists.withColumnRenamed("nodes", "low"), "key", names, "left")
    return back(_texts(pick(False).select(*names, "html", "url", none).unionByName(listed.select(*names, "html", "url", "low")), names))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", "url", ["page_id", "url"])
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: For pages of one article element each, whose headings and paragraphs hold inline markup only, and these character references.
OP13_SQL = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(
      string_split_regex(regexp_extract(html, '(?s)<article[^>]*>(.*?)(</article>|$)', 1), '</?(?:h[1-6]|p)(?:\s[^>]*)?>'),
      lambda b: trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'),
        '[\s\x{00A0}]+', ' ', 'g'))), lambda b: b <> ''), chr(10)), '') AS raw, regexp_replace(raw, '&amp;?', '&', 'g') AS text FROM pages)
"""
