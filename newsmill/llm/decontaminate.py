"""Benchmark decontamination by spaced seeds.

Texts are lower-cased and cut into words, which lose the ASCII punctuation at their ends; words of punctuation alone vanish. Fixed
masks over runs of words hash the selected words and ignore the others, so a substituted word breaks only seeds that select
it. The documents' seeds are joined with the benchmark's, behind a bitmap of fixed size. Each hit proposes an alignment of an item with the
document, in which the longest stretch with at least ``percent`` percent equal words is taken; it counts if it holds ``least`` words, or
the item where that is shorter, and is reported with the share of the item that it covers.

Items are merged by their words and go to the tasks as an index, in blocks of ``BLOCK_WORDS`` words: the benchmark is the query set, and
documents pass by once per block without a shuffle. A seed that many items share costs a task one comparison of words per item and
document, in which an alignment is dropped when too few words are equal for any stretch; it never becomes a row.

With the masks here every item of 15 words or more of which a fifth is substituted, however placed (15 words: proven for all
placements), has a seed hit; of all placements that the percentage allows in items of 7 to 14 words more than nine in ten have one.
Items of 1 to 6 words, shorter than a mask, are sought as they are. ``clean`` doesn't drop documents for whole items of fewer than ``PHRASE``
words, which any text may hold.

Rules for odd input: null and empty texts or items match nothing; items that repeat are each reported; rows that repeat a
doc_id are each searched and reported as one pair (the longest match); null ids are reported as null; other columns are
not read, and pass through ``clean`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, in_bitmap, joined, mix, pieces, small_batches, stored, without

#: Selected offsets of the masks.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 3, 4))
SPAN = max(m[-1] for m in MASKS) + 1
PHRASE = 5
BITS = 24
#: Words of items that are broadcast at a time (about 60 bytes each with their seeds).
BLOCK_WORDS = 500_000
#: Alignments, and words under alignments, that a task compares at a time.
ALIGNED, COMPARED = 500_000, 2_000_000
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(WordHashes):
    """As WordHashes, with the punctuation at the ends dropped; 0 for what is nothing else."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(_EDGES)
        self[word] = h = (xxhash.xxh3_64_intdigest(bare) or 1) if bare else 0
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        h = super().of(words)
        return h[h != 0]


def _select(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(h) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for o in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[o : o + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def _lower(c: str = "text"):
    return F.lower(F.coalesce(F.col(c), F.lit(""))).cast("binary")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, key (of the words) and words (64-bit hashes) of items with a word."""

    def run(batches):
        hashes = _Words()
        for b in batches:
            words = [hashes.of(t.split()) for t in b.column(1).to_pylist()]
            keep = pa.array([len(h) > 0 for h in words], pa.bool_())
            blobs = pa.array([h.tobytes() for h in words], pa.binary())
            keys = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in words], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), keys.filter(keep), blobs.filter(keep)], ["item_id", "key", "words"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", _lower().alias("text")).mapInArrow(run, f"item_id {kind}, key binary, words binary")


class _Index:
    """Items and their seeds, sorted by seed."""

    def __init__(self, keys: list[bytes], blobs: list[bytes], least: int):
        words = [np.frombuffer(w, np.uint64) for w in blobs]
        self.keys, self.size = keys, np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        #: Words that a stretch must hold.
        self.need = np.minimum(self.size, least)
        self.masks = [(m, k) for k, m in enumerate(MASKS)] + [(tuple(range(n)), 100) for n in sorted({len(w) for w in words if len(w) < SPAN})]
        seed, item, at = [], [], []
        for i, w in enumerate(words):
            for m, salt in self.masks:
                if salt < 100 if len(w) >= SPAN else len(m) == len(w):
                    x = _select(w, m, salt)
                    seed.append(x), item.append(np.full(len(x), i)), at.append(np.arange(len(x)))
        self.seed, self.item, self.at = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((seed, np.uint64), (item, np.int64), (at, np.int64)))
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.at = self.seed[order], self.item[order], self.at[order]
        self.bits = np.zeros(1 << BITS >> 3, np.uint8)
        for x in (self.seed, self.seed >> np.uint64(32)):
            x = x & np.uint64((1 << BITS) - 1)
            np.bitwise_or.at(self.bits, (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))

    def alignments(self, place: np.ndarray, low: np.ndarray, n: np.ndarray):
        """(items, shifts) of the seed hits of one document, a bounded number at a time; an alignment may come twice."""
        ends, first = np.cumsum(n), 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + ALIGNED, "right")))
            m = n[first:last]
            at = np.repeat(low[first:last] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            pair = np.unique(self.item[at] * (1 << 32) + np.repeat(place[first:last], m) - self.at[at] + (1 << 31))
            yield pair >> 32, (pair & ((1 << 32) - 1)) - (1 << 31)
            first = last

    def matches(self, doc: np.ndarray, items: np.ndarray, shifts: np.ndarray, percent: int):
        """(item, place in the document, words, equal words) of alignments with a stretch that counts; items that stick out are cut."""
        begin = np.maximum(shifts, 0)
        length = np.minimum(shifts + self.size[items], len(doc)) - begin
        ends, first = np.cumsum(length), 0
        while first < len(items):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COMPARED, "right")))
            i, b, n = items[first:last], begin[first:last], length[first:last]
            own = np.cumsum(n) - n
            off = np.arange(n.sum()) - np.repeat(own, n)
            same = doc[np.repeat(b, n) + off] == self.words[np.repeat(self.start[i] + b - shifts[first:last], n) + off]
            equal = np.add.reduceat(same.astype(np.int64), own)
            for x in np.flatnonzero(100 * equal >= percent * self.need[i]):
                s, e = longest_stretch(same[own[x] : own[x] + n[x]], percent)
                if e - s >= self.need[i[x]] or (s < e and 100 * equal[x] >= percent * self.size[i[x]]):
                    yield int(i[x]), int(b[x]) + s, e - s, int(same[own[x] + s : own[x] + e].sum())
            first = last


def _search(docs: DataFrame, index: _Index, percent: int) -> DataFrame:
    """doc_id, key (of the item's words), doc_word, n_words, n_equal: each row of ``docs`` with each item it holds, at the longest stretch."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix, hashes = shared.value, _Words()
        for b in pieces(batches, 300):
            each = [hashes.of(t.split()) for t in b.column(1).to_pylist()]
            ends = np.cumsum([len(h) for h in each])
            every = np.concatenate(each) if each else np.empty(0, np.uint64)
            hits = []
            for m, salt in ix.masks:
                s = _select(every, m, salt)
                p = np.flatnonzero(in_bitmap(ix.bits, BITS, s))
                low, high = (np.searchsorted(ix.seed, s[p], side) for side in ("left", "right"))
                d = np.searchsorted(ends, p, "right")
                ok = (low < high) & (p + m[-1] < ends[d] if len(p) else True)  # a seed lies within one text
                hits.append(np.stack([d[ok], p[ok], low[ok], (high - low)[ok]]))
            d, p, low, n = np.concatenate(hits, axis=1) if hits else np.empty((4, 0), np.int64)
            order = np.argsort(d, kind="stable")
            d, p, low, n = d[order], p[order], low[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]])) if len(d) else []
            rows = []
            for x, y in zip(cut[:-1], cut[1:]):
                doc, best = int(d[x]), {}
                place = p[x:y] - (int(ends[doc]) - len(each[doc]))
                for items, shifts in ix.alignments(place, low[x:y], n[x:y]):
                    for i, at, size, equal in ix.matches(each[doc], items, shifts, percent):
                        best[i] = max(best.get(i, (0, 0, 0)), (size, equal, -at))
                rows += [(doc, ix.keys[i], -at, size, equal) for i, (size, equal, at) in best.items()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.binary(), pa.int64(), pa.int64(), pa.int64())))],
                ["doc_id", "key", "doc_word", "n_words", "n_equal"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", _lower().alias("text")).mapInArrow(run, f"doc_id {kind}, key binary, doc_word long, n_words long, n_equal long")


def longest_stretch(same: np.ndarray, percent: int) -> tuple[int, int]:
    """[start, end) of the longest stretch with at least ``percent`` percent true, trimmed to true ends; the first of equals."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    later = np.maximum.accumulate(total[::-1])[::-1]  # falls, so the farthest place that is no lower is found by bisection
    far = np.searchsorted(-later, -total, "right") - 1
    start = int(np.argmax(far - np.arange(len(total))))
    inside = np.flatnonzero(same[start : far[start]])
    return (start + int(inside[0]), start + int(inside[-1]) + 1) if len(inside) else (start, start)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = 80, least: int = 13) -> DataFrame:
    """doc_id, item_id, doc_word (where the stretch starts among the document's words), n_words, n_equal, share (of the item's words): a
    row per pair of a document and a benchmark item that it holds or holds ``least`` words of, with the longest stretch."""
    items = stored(_items(benchmark), "decon-items")
    distinct = stored(items.groupBy("key").agg(F.first("words").alias("words")), "decon-distinct")
    blocks = max(1, -(-(distinct.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // (8 * BLOCK_WORDS)))
    found = None
    for i in range(blocks):
        rows = distinct.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).orderBy("key").collect()  # about BLOCK_WORDS words
        more = _search(docs, _Index([bytes(r.key) for r in rows], [bytes(r.words) for r in rows], least), percent)
        found = more if found is None else found.unionByName(more)
    best = F.max(F.struct("n_words", "n_equal", (-F.col("doc_word")).alias("first"))).alias("b")
    b = F.col("b")
    pairs = stored(found.groupBy("doc_id", "key").agg(best), "decon-pairs")
    out = joined(pairs, items.select("key", "item_id", (F.octet_length("words") / 8).alias("size")), "key", ["doc_id"])
    return out.select("doc_id", "item_id", (-b["first"]).alias("doc_word"), b["n_words"].alias("n_words"), b["n_equal"].alias("n_equal"), (b["n_words"] / F.col("size")).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage of PHRASE words or more; texts stand for their rows here, so ids may repeat or
    be null."""
    key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    found = find_overlaps(docs.select(key.alias("doc_id"), "text"), benchmark).where(F.col("n_words") >= PHRASE)
    return without(docs, key, stored(found.select(F.col("doc_id").alias("key")).distinct(), "decon-found"))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return find_overlaps(read("documents"), read("benchmark"))
