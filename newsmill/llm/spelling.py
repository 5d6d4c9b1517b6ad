"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, and the common form they lead to.

Neighbours are found on a trie that is a table: a row for each prefix (node) with its edges, the next letters. A state is a pair of nodes
(a, b) that one edit parts, so a is a word read up to some position, and b the node it has reached with its edit used. States
start where one node's edges part (a letter replaced) or where a letter is put in before another one or at the end of a word,
and each level's frontier is joined with that level's edges on both nodes; where both nodes are words, they are neighbours.
As every word with the same beginning shares one state, and a state's b is within one edit of its a, a node has at most some
2 * length * alphabet states: no key is hot, whatever the words are. A letter is put into a run of equal ones only at the
run's end, so each pair arises once. A node with a single word below it holds that word, and a pair of such nodes is decided on the spot.

Levels are as many as the letters of the words they hold, so words longer than ``trie_len`` are compared in another exact way:
by the hashes of what is left when each letter is deleted, joined by hash and place and confirmed on the words.

Odd input: null texts hold no words; a null doc_id deletes nothing; rows that repeat an id all count; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, joined, small_batches, stored, text_bytes

#: Letters A-Z (lower-cased before) and U+00C0 to U+00FF in UTF-8. Fixed values.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
TYPO = 199
#: Words held by one task before they are sent on.
HELD = 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo: int = TYPO) -> DataFrame:
    """(word, n) over all whole texts; a run loses one letter where ``typo`` divides its crc32 with the id. Tasks send partial counts."""

    def run(batches):
        held: Counter = Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = Counter(RUN.findall(text.as_py().lower()))
                base = None if doc is None else zlib.crc32(doc.encode() + b":")
                for w, n in found.items():
                    if base is not None and (h := zlib.crc32(w, base)) % typo == 0:
                        s = w.decode()
                        at = h % len(s)
                        w = (s[:at] + s[at + 1 :]).encode()
                    held[w] += n
                if len(held) > HELD:
                    yield sent()
        if held:
            yield sent()

    rows = small_batches(docs).select(F.col(id_col).cast("string").alias("doc"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- the trie ------------------------------------------------------------------------------------


def trie(words: DataFrame) -> DataFrame:
    """(node, depth, word, kids): each prefix that goes on, whether it is a word, and its edges (ch, single, word).

    ``single`` is the only word below an edge, null where there are several. Edges of a node are as many as letters at most."""
    depth = F.explode(F.sequence(F.lit(0), F.char_length("word")))
    prefixes = words.select("word", depth.alias("depth")).select("word", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"))
    nodes = prefixes.groupBy("node", "depth").agg(F.count("*").alias("n"), F.min("word").alias("first"), F.max(F.col("word") == F.col("node")).alias("word"))
    up = F.substring("node", F.lit(1), F.col("depth") - 1)
    edge = F.struct(F.substring("node", F.col("depth"), F.lit(1)).alias("ch"), F.when(F.col("n") == 1, F.col("first")).alias("single"), F.col("word"))
    own = nodes.select("node", "depth", F.col("word").alias("whole"), F.lit(None).cast("struct<ch:string,single:string,word:boolean>").alias("kid"))
    kids = nodes.where("depth > 0").select(up.alias("node"), (F.col("depth") - 1).alias("depth"), F.lit(None).cast("boolean").alias("whole"), edge.alias("kid"))
    rows = own.unionByName(kids).groupBy("node", "depth").agg(F.coalesce(F.max("whole"), F.lit(False)).alias("word"), F.sort_array(F.collect_list("kid")).alias("kids"))
    return rows.where(F.size("kids") > 0)


def _state(a: Column, b: Column, x: Column, y: Column, near: Column | None = None) -> Column:
    """The pair of nodes below ``a`` and ``b`` by the edges ``x`` and ``y``, whose next letters are read: live if it may go on, near if
    both are words. Two edges with one word each are decided by what these have left."""
    both = x["single"].isNotNull() & y["single"].isNotNull()
    rest = lambda node, e: F.substr(e["single"], F.char_length(node) + 2)
    same = rest(a, x) == rest(b, y)
    return F.struct(
        F.when(both, x["single"]).otherwise(F.concat(a, x["ch"])).alias("a"),
        F.when(both, y["single"]).otherwise(F.concat(b, y["ch"])).alias("b"),
        F.when(both, same).otherwise(x["word"] & y["word"]).alias("near"),
        (~both).alias("live"),
    )


def _unfolded(rows: DataFrame, states: Column) -> DataFrame:
    return rows.select(F.explode(states).alias("s")).select("s.*").where("near or live")


def _starts(nodes: DataFrame) -> DataFrame:
    """States in which the edit has just been made, at every depth."""
    node, kids = F.col("node"), F.col("kids")
    swapped = _unfolded(nodes, F.flatten(F.transform(kids, lambda x, i: F.transform(F.slice(kids, i + 2, F.size(kids)), lambda y: _state(node, node, x, y)))))
    ended = nodes.where("word").select("node", F.explode(F.filter("kids", lambda x: x["word"])).alias("x")).select(F.col("node").alias("a"), F.concat("node", "x.ch").alias("b"), F.lit(True).alias("near"), F.lit(False).alias("live"))
    below = nodes.where("depth > 0").select(F.substring("node", F.lit(1), F.col("depth") - 1).alias("node"), F.col("node").alias("longer"), F.substr("node", "depth").alias("put"), F.col("kids").alias("after"))
    pairs = nodes.select("node", "kids").join(below, "node")  # an alphabet's rows a node at most
    fits = F.arrays_overlap(F.transform(F.filter("kids", lambda x: x["ch"] != F.col("put")), lambda x: x["ch"]), F.transform("after", lambda y: y["ch"]))
    put = _unfolded(pairs.where(fits), _matched(F.col("node"), F.col("longer"), F.filter("kids", lambda x: x["ch"] != F.col("put")), F.col("after")))
    return swapped.unionByName(ended).unionByName(put)


def _matched(a: Column, b: Column, xs: Column, ys: Column) -> Column:
    """States below ``a`` and ``b`` by their equal letters."""
    at = lambda x: F.element_at(F.filter(ys, lambda y: y["ch"] == x["ch"]), 1)
    shared = F.filter(xs, lambda x: F.exists(ys, lambda y: y["ch"] == x["ch"]))
    return F.transform(shared, lambda x: _state(a, b, x, at(x)))


def trie_neighbours(words: DataFrame) -> DataFrame:
    """Stored (a, b): every unordered pair of ``words`` (word, distinct) one edit apart, once. The frontier is written level by level."""
    nodes = stored(trie(words), "spelling-trie")
    level = F.char_length("a")
    first = stored(_starts(nodes).withColumn("depth", F.when(F.col("live"), level).otherwise(0)), "spelling-starts")
    begin = {r.depth for r in first.where("live").groupBy("depth").count().collect()}  # a row a level
    tables, live = [first], None
    for d in range(1, max(begin, default=0) + 10**6):
        if live is None and d > max(begin, default=0):
            break
        front = [x for x in (live, first.where(F.col("live") & (F.col("depth") == d)).select("a", "b") if d in begin else None) if x is not None]
        if not front:
            continue
        states = front[0] if len(front) == 1 else front[0].unionByName(front[1])
        here = nodes.where(F.col("depth") == d).select(F.col("node").alias("a"), F.col("kids").alias("xs"))
        there = nodes.where((F.col("depth") == d) | (F.col("depth") == d + 1)).select(F.col("node").alias("b"), F.col("kids").alias("ys"))
        now = stored(_unfolded(states.join(here, "a").join(there, "b"), _matched(F.col("a"), F.col("b"), F.col("xs"), F.col("ys"))), "spelling-level")
        tables.append(now)
        live = now.where("live").select("a", "b")
        live = live if live.limit(1).count() else None
    pairs = tables[0].where("near").select("a", "b")
    for t in tables[1:]:
        pairs = pairs.unionByName(t.where("near").select("a", "b"))
    out = stored(pairs, "spelling-pairs")
    for t in [nodes, *tables]:
        drop_stored(t)
    return out


def long_neighbours(words: DataFrame, beyond: int) -> DataFrame:
    """(a, b): unordered pairs one edit apart of which the longer has more than ``beyond`` code points, once each.

    Hashes travel, a row for each code point; a place and a rest are shared by as many words as there are letters at most."""
    named = words.where(F.char_length("word") >= beyond).select("word", F.xxhash64("word").alias("id"), F.char_length("word").alias("size"))
    rest = F.concat(F.substr("word", F.lit(1), F.col("at") - 1), F.substr("word", F.col("at") + 1))
    less = named.where(F.col("size") > beyond).select("id", "word", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("at")).select("id", "at", F.xxhash64(rest).alias("rest"))
    swapped = less.alias("x").join(less.alias("y"), ["rest", "at"]).where("x.id < y.id").select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    put = less.join(named.select(F.col("id").alias("rest"), F.col("id").alias("j")), "rest").select(F.col("id").alias("i"), "j")
    ids = swapped.unionByName(put).distinct()
    whole = named.select("id", "word")
    pairs = ids.join(whole.toDF("i", "a"), "i").join(whole.toDF("j", "b"), "j")
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def neighbours(words: DataFrame, trie_len: int = 48) -> DataFrame:
    """Stored (a, b) of ``words`` (one column word, distinct, not null): every unordered pair one edit apart, once."""
    near = trie_neighbours(words.where(F.char_length("word") <= trie_len))
    if words.where(F.char_length("word") > trie_len).limit(1).count():
        near = stored(near.unionByName(long_neighbours(words, trie_len)), "spelling-near")
    return near


# --- forms ---------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> stored (word, root): the end of each word's chain of forms, the way doubled in every round.

    Each step multiplies a word's count, so chains are as long as a logarithm of the largest count."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = joined(now, now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", ["word"], "left")
        new = stored(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_stored(now)
        now = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return now


def variants(counts: DataFrame, times: int = 5, trie_len: int = 48) -> DataFrame:
    """(word, n) -> word, form, root, n, n_near, form_n; ``form`` is the commonest near word if it is ``times`` as common as the word."""
    near = neighbours(counts.select("word"), trie_len)
    both = near.union(near.select("b", "a")).toDF("word", "other")
    ranked = both.join(counts.toDF("other", "m"), "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    common = -F.col("top.m") >= times * F.col("n")
    rows = stored(
        counts.join(ranked, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("top.other")).alias("form"), F.when(common, -F.col("top.m")).alias("form_n")
        ),
        "spelling-forms",
    )
    drop_stored(near)
    roots = _roots(rows.where(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return variants(stored(counts.where((F.col("n") >= 5) & (F.char_length("word") >= 6)), "spelling-words"))


OP12_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents)
  GROUP BY doc_id, w),
hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM (SELECT w, k, hex(encode(doc_id || ':' || w)) AS h FROM runs)),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1),
words AS MATERIALIZED (SELECT word, n FROM counted WHERE n >= 5 AND length(word) >= 6),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT x.word AS word, y.word AS other FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON rest = words.word),
ranked AS MATERIALIZED (
  SELECT near.word, count(*) AS n_near, min(struct_pack(m := -words.n, w := other)) AS top FROM near JOIN words ON other = words.word GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 5 * w.n THEN top.w END AS form, CASE WHEN -top.m >= 5 * w.n THEN (-top.m)::BIGINT END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word),
way AS (SELECT word, word AS last FROM words UNION ALL SELECT way.word, form FROM way JOIN forms ON forms.word = way.last WHERE form IS NOT NULL)
SELECT f.word, f.form, last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way ON way.word = f.word JOIN forms e ON e.word = last WHERE e.form IS NULL
"""
