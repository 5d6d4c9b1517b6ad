"""Repeated passages by a sparse suffix array.

A position of a text is kept if the 16-word run that starts there has the least hash of the runs in some window of ``LEAST`` words:
every window of that length has exactly one such minimiser, chosen by content alone, so equal windows choose alike. Suffixes
at kept positions are dealt out by their first run, sorted, and compared with their neighbours (longest common prefixes); rows that
share enough words to the right are then extended to the left, by hashes of the words before them. That finds every window of
``LEAST`` words that occurs more than once, and unites them to passages.

Equal texts are one text until the end, and a task sends a text once. Only runs that occur twice send their suffix (at most
``LEAST`` words to the right, fewer to the left, all that a window can reach); a bitmap of fixed size pre-selects them. A run that
occurs more than ``hot`` times, whatever the corpus, goes a way of its own, in which its windows are counted with partial sums and no
task sees the whole group; a second bitmap tells the two ways apart, and both give the same.

A word is a run of characters that are not ASCII white space, taken as written. Of the places where a window occurs the first
is the one in the text with the smallest MD5, and leftmost there; of rows with equal texts the smallest doc_id comes first.
Words in windows that are not first are removable.

Rules for odd input: null and empty texts and those of fewer than ``LEAST`` words repeat nothing; a null doc_id comes after all
others; rows that repeat both doc_id and text count as copies and are all first; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, bitmap_of, in_bitmap, joined, mix, pieces, small_batches, stored, windows

LEAST, RUN = 50, 16
_REACH = LEAST - RUN + 1
BITS, HOT_BITS = 27, 24
HOT = 20_000


def minimisers(each: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """For word-hash sequences: text number, place, run hash, and the least and most words between a window's start and the place."""
    sizes = np.array([len(h) for h in each])
    none = np.empty(0, np.int64)
    if not len(sizes) or sizes.max() < LEAST:
        return none, none, np.empty(0, np.uint64), none, none
    every = np.concatenate(each)
    run = windows(every, RUN)
    place_mask = np.uint64((1 << 28) - 1)  # the same for every batch, since it decides which bits of a hash count
    m = (run & ~place_mask) | np.arange(len(run), dtype=np.uint64)
    span = 1
    while span * 2 <= _REACH:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if _REACH > span:
        m = np.minimum(m[: len(m) - (_REACH - span)], m[_REACH - span :])
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(m)]
    inside = np.arange(len(m)) + LEAST <= (starts + sizes)[text]
    begin = np.flatnonzero(inside)
    at = (m[begin] & place_mask).astype(np.int64)
    text = text[begin]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    p = at[new]
    return text[new], p - starts[text[new]], run[p], p - begin[last], p - begin[new]


class _Texts:
    """Batches of (key, text) as word hashes; a text that this task has seen is left out."""

    def __init__(self):
        self.hashes, self.seen = WordHashes(), set()

    def __call__(self, batches):
        for b in pieces(batches, 400):
            keys, each = [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key not in self.seen:
                    self.seen.add(key)
                    keys.append(key)
                    each.append(self.hashes.of(t.split()))
            yield keys, each


def _ids(keys: list[bytes], text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit name of a place in a text."""
    k = np.array([int.from_bytes(x[:8], "little") for x in keys], np.uint64)
    return mix(k[text] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(texts: DataFrame) -> DataFrame:
    """Run hashes at kept positions with the name of the place."""

    def run(batches):
        for keys, each in _Texts()(batches):
            text, place, gram, _, _ = minimisers(each)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(_ids(keys, text, place).view(np.int64))], ["gram", "id"])

    return texts.mapInArrow(run, "gram long, id long")


SUFFIX = "gram long, key binary, place int, o_min short, o_max short, left binary, right binary"


def _suffixes(texts: DataFrame, bitmap: bytes, hot: bytes) -> DataFrame:
    """Suffixes at kept positions whose run may occur elsewhere: words as big-endian hashes, so that bytes sort as words do."""
    shared = texts.sparkSession.sparkContext.broadcast((bitmap, hot))

    def run(batches):
        bits, hot = (np.frombuffer(x, np.uint8) for x in shared.value)
        for keys, each in _Texts()(batches):
            text, place, gram, o_min, o_max = minimisers(each)
            ok = in_bitmap(bits, BITS, gram) & ~in_bitmap(hot, HOT_BITS, gram)
            text, place, gram, o_min, o_max = (x[ok] for x in (text, place, gram, o_min, o_max))
            rows = []
            for t, p, a, z in zip(text.tolist(), place.tolist(), o_min.tolist(), o_max.tolist()):
                h = each[t]
                rows.append((keys[t], h[p - z : p][::-1].astype(">u8").tobytes(), h[p : p + LEAST - a].astype(">u8").tobytes()))
            k, left, right = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram.view(np.int64)), pa.array(list(k), pa.binary()), pa.array(place, pa.int32()), pa.array(o_min, pa.int16()),
                    pa.array(o_max, pa.int16()), pa.array(list(left), pa.binary()), pa.array(list(right), pa.binary()),
                ],
                ["gram", "key", "place", "o_min", "o_max", "left", "right"],
            )

    return texts.mapInArrow(run, SUFFIX)


def _padded(cells: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(c) // 8 for c in cells])
    out = np.zeros((len(cells), width), ">u8")
    for i, c in enumerate(cells):
        out[i, : len(c) // 8] = np.frombuffer(c, ">u8")
    return out.astype(np.uint64), size


def _compare(t: pa.Table) -> pa.RecordBatch:
    """Repeated stretches around the suffixes of ``t``, which holds whole runs and is sorted by run and right-hand words."""
    n = t.num_rows
    gram, place, o_min, o_max = (t.column(c).to_numpy() for c in ("gram", "place", "o_min", "o_max"))
    keys = t.column("key").to_pylist()
    right, size = _padded(t.column("right").to_pylist(), LEAST)
    left, _ = _padded(t.column("left").to_pylist(), _REACH)
    # Common prefix of each suffix with the one before.
    differs = right[1:] != right[:-1]
    lcp = np.where(differs.any(1), differs.argmax(1), LEAST)
    lcp = np.where(gram[1:] == gram[:-1], np.minimum(lcp, np.minimum(size[1:], size[:-1])), -1)
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    rank = np.array([order[k] for k in keys]) * (1 << 32) + place  # (text, place) as one number
    # Least and most repeated offsets of a place; the second pair for windows that are not first.
    least, most, later_least, later_most = np.full(n, 1 << 30), np.full(n, -1), np.full(n, 1 << 30), np.full(n, -1)
    before = np.zeros(n, np.uint64)  # hash of the o words before the place
    for o in range(_REACH):
        if o:
            before = mix(before * np.uint64(0x9E3779B97F4A7C15) + left[:, o - 1])
        interval = np.concatenate([[0], np.cumsum(lcp < LEAST - o)]).astype(np.uint64)
        at = np.flatnonzero((o_min <= o) & (o <= o_max))
        if len(at) < 2:
            continue
        name = mix(before[at] + mix(interval[at] + np.uint64(1)))
        by = np.lexsort((rank[at], name))
        s, at = name[by], at[by]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        group = np.cumsum(first) - 1
        # The same place of a text may come from several tasks: a window is repeated if it has two different places.
        later = rank[at] != rank[at][np.flatnonzero(first)][group]
        r = at[np.bincount(group, weights=later)[group] > 0]
        least[r] = np.minimum(least[r], o)
        most[r] = o
        later_least[at[later]] = np.minimum(later_least[at[later]], o)
        later_most[at[later]] = o
    # Offset o stands for the window [place - o, place - o + LEAST); all windows of a place hold it, so they unite.
    parts = []
    for low, high, flag in ((least, most, False), (later_least, later_most, True)):
        r = np.flatnonzero(high >= 0)
        parts.append((r, place[r] - high[r], place[r] - low[r] + LEAST, np.full(len(r), flag)))
    rows, start, end, flags = (np.concatenate(c) for c in zip(*parts))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()).take(pa.array(rows)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(flags)], ["key", "start", "end", "later"]
    )


STRETCH = "key binary, start int, end int, later boolean"


def _neighbours(suffixes: DataFrame, parts: int, rows: int = 20_000) -> DataFrame:
    """Stretches from suffixes sorted within their partition; a run's suffixes are compared together, many runs at a time."""

    def run(batches):
        kept: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            kept.append(b)
            held += b.num_rows
            if held < rows:
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            gram = t.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last run may go on
            if cut:
                yield _compare(t.slice(0, cut))
            kept, held = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if held:
            yield _compare(pa.Table.from_batches(kept).combine_chunks())

    return suffixes.repartition(parts, "gram").sortWithinPartitions("gram", "right", "key", "place").mapInArrow(run, STRETCH)


def _counted(texts: DataFrame, hot: bytes) -> DataFrame:
    """The same for runs in the bitmap ``hot``: every window is a row and windows are counted with partial sums."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for keys, each in _Texts()(batches):
            text, place, gram, o_min, o_max = minimisers(each)
            ok = in_bitmap(bits, HOT_BITS, gram)
            k, starts, names = [], [], []
            for t in np.unique(text[ok]):
                w = windows(each[t], LEAST).view(np.int64)
                for p, a, z in zip(*(x[ok & (text == t)].tolist() for x in (place, o_min, o_max))):
                    k += [keys[t]] * (z - a + 1)
                    starts += range(p - z, p - a + 1)
                    names += w[p - z : p - a + 1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(k, pa.binary()), pa.array(starts, pa.int32())], ["name", "key", "start"])

    rows = stored(texts.mapInArrow(run, "name long, key binary, start int"), "suffix-hot")
    place = F.struct("key", "start")
    again = rows.groupBy("name").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("name", "first")
    hit = joined(rows, stored(again, "suffix-again"), "name", ["key", "start"])
    hit = hit.select("key", "start", (F.col("start") + LEAST).cast("int").alias("end"), (place != F.col("first")).alias("later"))
    return hit.select("key", "start", "end", F.lit(False).alias("later")).union(hit.where("later"))


def _united(stretches: DataFrame) -> DataFrame:
    """key, start, end of united stretches and how many of their words are removable. A group is one text's stretches."""

    def unite(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(end[order])
        new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
        return start[new], reach[np.concatenate([new[1:], [len(start)]]) - 1]

    def run(t: pa.Table) -> pa.Table:
        start, end, later = (t.column(c).to_numpy() for c in ("start", "end", "later"))
        s, e = unite(start, end)
        removable = np.zeros(len(s), np.int64)
        if later.any():
            ls, le = unite(start[later], end[later])
            np.add.at(removable, np.searchsorted(s, ls, "right") - 1, le - ls)
        return pa.table({"key": [t.column("key")[0].as_py()] * len(s), "start": pa.array(s, pa.int64()), "end": pa.array(e, pa.int64()), "removable": removable})

    # A text with copies in many tasks has the same stretches from each.
    return stretches.distinct().groupBy("key").applyInArrow(run, "key binary, start long, end long, removable long")


def repeated_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, start_word, end_word, n_removable: a row per maximal stretch of words of ``docs`` covered by windows of LEAST words that
    occur more than once in the corpus (in other documents or again in this one)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = small_batches(docs).select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    slim = stored(keyed.select("doc_id", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n")).where(F.col("n") >= LEAST), "suffix-docs")
    texts = keyed.select("key", F.col("text").cast("binary").alias("text"))

    runs = _runs(texts).groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    again = stored(runs.where("a <> b").select("gram", "n"), "suffix-runs")
    total, most = again.agg(F.sum("n"), F.max("n")).first()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, (total or 0) // 100_000 + 1)
    crowded = (most or 0) > hot
    hot_runs = bitmap_of(again.where(F.col("n") > hot), "gram", HOT_BITS) if crowded else bytes(1 << HOT_BITS >> 3)
    stretches = _neighbours(_suffixes(texts, bitmap_of(again, "gram", BITS), hot_runs), parts)
    if crowded:
        stretches = stretches.unionByName(_counted(texts, hot_runs))
    spans = stored(_united(stretches), "suffix-spans")

    # Copies of a text repeat as a whole; the first keeps what its text's windows keep. A text without copies is its group's only row.
    groups = slim.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    alone = groups.where("copies = 1").join(spans, "key")
    alone = alone.select(F.col("first").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("removable").alias("n_removable"))
    totals = spans.groupBy("key").agg(F.sum("removable").alias("total"))
    repeated = stored(groups.where("copies > 1").join(totals, "key", "left").select("key", "first", F.coalesce("total", F.lit(0)).alias("total")), "suffix-copies")
    n_removable = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.col("total")).otherwise(F.col("n")).cast("long")
    copied = joined(slim, repeated, "key", ["doc_id"])  # one text may be a third of all rows
    copied = copied.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), n_removable.alias("n_removable"))
    return alone.unionByName(copied)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH t AS (SELECT md5(text) AS key, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
g AS (SELECT key, CAST(i AS INTEGER) AS s, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM t, unnest(range(0, len(w) - 49)) r(i) WHERE len(w) >= 50),
f AS (SELECT key, s, row_number() OVER (PARTITION BY h ORDER BY key, s) > 1 AS later, count(*) OVER (PARTITION BY h) AS n FROM g),
r AS (SELECT key, s, later FROM f WHERE n > 1),
i1 AS (SELECT key, s, coalesce(s > lag(s) OVER (PARTITION BY key ORDER BY s) + 50, true) AS new FROM r),
i2 AS (SELECT key, s, sum(CAST(new AS INTEGER)) OVER (PARTITION BY key ORDER BY s) AS island FROM i1),
spans AS (SELECT key, min(s) AS a, max(s) + 50 AS z FROM i2 GROUP BY key, island),
l1 AS (SELECT key, s, least(s - coalesce(lag(s) OVER (PARTITION BY key ORDER BY s), -50), 50) AS fresh FROM r WHERE later),
rem AS (SELECT spans.key, a, z, coalesce(sum(fresh), 0) AS removable FROM spans LEFT JOIN
         (SELECT key, s, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY s) = 1 THEN 50 ELSE fresh END AS fresh FROM l1) l
         ON spans.key = l.key AND l.s >= a AND l.s < z GROUP BY spans.key, a, z),
d AS (SELECT doc_id, md5(text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n,
             count(*) OVER (PARTITION BY md5(text)) AS copies, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents WHERE text IS NOT NULL),
p AS (SELECT key, sum(removable) AS total FROM rem GROUP BY key)
SELECT doc_id, CAST(a AS BIGINT) AS start_word, CAST(z AS BIGINT) AS end_word, CAST(removable AS BIGINT) AS n_removable FROM d JOIN rem ON d.key = rem.key WHERE copies = 1
UNION ALL
SELECT doc_id, 0, CAST(n AS BIGINT), CAST(CASE WHEN doc_id = first THEN coalesce(total, 0) ELSE n END AS BIGINT)
FROM d LEFT JOIN p ON d.key = p.key WHERE copies > 1 AND n >= 50
"""
