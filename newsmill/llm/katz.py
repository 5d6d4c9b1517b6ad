"""Katz back-off language model over words, by partitioned count tables.

A seen pair of words has its Good-Turing discounted share of its history's count; an unseen one has the discounted unigram
probability times the history's back-off weight, which is the mass that the discounts left, over the unigram mass of the words
not seen after that history; so every history's probabilities sum to one. Words not seen in training are one unknown word, which
has the unigrams' left-over mass. A history not seen in training backs off with weight one.

Work is dealt out by history. The first pass over the texts counts words and notes which partitions will need a word's
count; the second sends each partition its pairs with the documents that hold them, packed as arrays and summed by chunk. From one
shuffle of these, a first branch takes the counts of counts, which the discounts need, and a second scores the pairs and
returns partial sums per document. A frequent history is dealt out by pair, and of frequent pairs only counts go to one partition
while the documents stay spread; totals of both come back by broadcast. A frequent word or pair makes up at least 1 / (2 x partitions)
of the sample that names it, so there are 4 x partitions of them at most (some 11 MB for a TB of text). That sample decides where
rows are sent and nothing else.

Rules for odd input: a null or empty text is the end alone; documents with a null doc_id are scored and not learnt from;
repeated rows are each learnt from and scored; without training text every probability is that of the unknown word, 1; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mix, pieces, small_batches, stored, text_bytes

END, START = (xxhash.xxh3_64_intdigest(x) for x in (b" ", b"\t"))  # no word has these bytes
KEPT = 5  # counts above this are not discounted
CHUNK = 1_500_000  # words that a task packs at a time
_C = np.uint64(0x9E3779B97F4A7C15)
PACK = "bucket int, kind int, chunk long, n long, h binary, w binary, hi binary, wi binary, train binary, occ binary, docs binary"
_COLS = [c.split()[0] for c in PACK.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 7
PAIRS, DOCS, WORDS, STATS = range(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_COLS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], _COLS)


def _row(bucket=0, kind=PAIRS, chunk=0, n=0, *arrays) -> tuple:
    blobs = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return (bucket, kind, chunk, n, *blobs, *[b""] * (7 - len(blobs)))


def _small(a: np.ndarray) -> np.ndarray:
    """As unsigned integers of the least width that holds them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit name of a pair of words."""
    return mix(h * _C + mix(w))


class _Deal:
    """Which partition a pair goes to."""

    def __init__(self, parts: int, hot: np.ndarray, pairs: np.ndarray):
        self.parts, self.hot, self.pairs = parts, np.sort(hot.astype(np.uint64)), np.sort(pairs.astype(np.uint64))

    @staticmethod
    def _among(values: np.ndarray, those: np.ndarray) -> np.ndarray:
        at = np.searchsorted(those, values)
        return those[np.minimum(at, len(those) - 1)] == values if len(those) else np.zeros(len(values), bool)

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        return self._among(words, self.hot)

    def is_hot_pair(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self._among(_pair(h, w), self.pairs)

    def __call__(self, h: np.ndarray, w: np.ndarray, hot_h: np.ndarray) -> np.ndarray:
        key = mix(np.where(hot_h, h * _C + w, h))
        return ((key >> np.uint64(8)) % np.uint64(self.parts)).astype(np.int64)

    def home_of_word(self, w: np.ndarray) -> np.ndarray:
        return ((mix(w) >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int64)


def _chunks(batches):
    """(doc ids, training flags, words per document, word hashes, history hashes, document numbers) for about CHUNK words each."""
    hashes = WordHashes(200_000)
    ids, flags, each, size = [], [], [], 0

    def out():
        sizes = np.array([len(e) for e in each])
        w = np.concatenate(each)
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[np.cumsum(sizes) - sizes] = np.uint64(START)
        return ids, np.array(flags, bool), sizes, w, h, np.repeat(np.arange(len(sizes)), sizes)

    end = np.array([END], np.uint64)
    for b in pieces(batches, 300):
        for i, f, t in zip(*(b.column(c).to_pylist() for c in range(3))):
            ids.append(i)
            flags.append(f)
            each.append(np.concatenate([hashes.of(t.lower().split()), end]))
            size += len(each[-1])
            if size >= CHUNK:
                yield out()
                ids, flags, each, size = [], [], [], 0
    if each:
        yield out()


def _sorted_parts(bucket: np.ndarray, parts: int):
    """(bucket, slice) of an ascending array of buckets."""
    ends = np.searchsorted(bucket, np.arange(parts + 1))
    return ((b, slice(ends[b], ends[b + 1])) for b in range(parts) if ends[b] < ends[b + 1])


def word_table(docs: DataFrame, deal: _Deal) -> DataFrame:
    """Stored rows: per pair partition, the words it needs with their training counts; and statistics (tokens, words, counts of counts)."""
    parts = deal.parts

    def count(batches):
        for _, flags, _, w, h, doc in _chunks(batches):
            words, inverse = np.unique(w, return_inverse=True)
            train = np.bincount(inverse, weights=flags[doc], minlength=len(words)).astype(np.int64)
            need = np.unique(inverse * parts + deal(h, w, deal.is_hot(h)))
            word, bucket = need // parts, need % parts
            degree = np.bincount(word, minlength=len(words))
            home = deal.home_of_word(words)
            order = np.argsort(home, kind="stable")
            first = np.concatenate([[0], np.cumsum(degree)])
            rows = []
            for b, s in _sorted_parts(home[order], parts):
                at = order[s]
                d = degree[at]
                take = np.repeat(first[at] - (np.cumsum(d) - d), d) + np.arange(d.sum())
                rows.append(_row(b, WORDS, 0, len(at), words[at], _small(train[at]), _small(d), _small(bucket[take])))
            yield _batch(rows)

    def add(batches):
        words, train, degree, bucket = [], [], [], []
        for b in batches:
            for n, w, t, d, k in zip(*(b.column(c).to_pylist() for c in (3, 4, 5, 6, 7))):
                words.append(np.frombuffer(w, np.uint64))
                train.append(_wide(t, n))
                degree.append(_wide(d, n))
                bucket.append(_wide(k, int(degree[-1].sum())))
        if not words:
            return
        u, inverse = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate(train)).astype(np.int64)
        need = np.unique(np.concatenate(bucket) * len(u) + np.repeat(inverse, np.concatenate(degree)))
        to, word = need // len(u), need % len(u)
        known = (c[word] > 0) & ~deal.is_hot(u)[word]
        to, word = to[known], word[known]
        rows = [_row(b, WORDS, 0, len(word[s]), u[word[s]], _small(c[word[s]])) for b, s in _sorted_parts(to, parts)]
        hot = np.flatnonzero(deal.is_hot(u) & (c > 0))
        if len(hot):  # frequent words are needed everywhere
            rows += [_row(b, WORDS, 0, len(hot), u[hot], _small(c[hot])) for b in range(parts)]
        stats = [c.sum(), (c > 0).sum(), *(np.count_nonzero(c == r) for r in range(1, KEPT + 2))]
        yield _batch([*rows, _row(0, STATS, 0, len(stats), np.array(stats, np.int64))])

    return stored(docs.mapInArrow(count, PACK).repartitionById(parts, F.col("bucket")).mapInArrow(add, PACK), "katz-words")


def _packed(docs: DataFrame, deal: _Deal) -> DataFrame:
    """Per chunk and partition: pairs with training counts and documents; and per chunk the list of its documents."""
    parts = deal.parts

    def pack(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for ids, flags, sizes, w, h, doc in _chunks(batches):
            hot_h = deal.is_hot(h)
            pair = _pair(h, w)
            hot = deal.is_hot_pair(h, w)
            bucket = deal(h, w, hot_h)
            bits = np.uint64(max(1, int(parts - 1).bit_length()))
            order = np.argsort((bucket.astype(np.uint64) << (np.uint64(64) - bits)) | (pair >> bits), kind="stable")
            p = pair[order]
            new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            occ = np.diff(np.concatenate([new, [len(p)]]))
            train = np.add.reduceat(flags[doc[order]].astype(np.int64), new)
            head = order[new]
            ph, pw, pb, pd, phot = h[head], w[head], bucket[head], doc[order], hot[head]
            first = np.concatenate([[0], np.cumsum(occ)])
            rows = []
            anywhere = int(mix(np.array([chunk], np.uint64))[0] % np.uint64(parts))

            def send(b, at, train, with_docs):
                uh, hi = np.unique(ph[at], return_inverse=True)
                uw, wi = np.unique(pw[at], return_inverse=True)
                o = occ[at] if with_docs else np.zeros(len(at), np.int64)
                take = np.repeat(first[at] - (np.cumsum(o) - o), o) + np.arange(o.sum())
                rows.append(_row(b, PAIRS, chunk, len(at), uh, uw, _small(hi), _small(wi), _small(train), _small(o), _small(pd[take])))

            for b, s in _sorted_parts(pb, parts):
                at = np.arange(s.start, s.stop)
                plain, both = at[~phot[at]], at[phot[at]]
                if len(plain):
                    send(b, plain, train[plain], True)
                if len(both):
                    send(b, both, train[both], False)
            both = np.flatnonzero(phot)
            if len(both):  # the documents of frequent pairs go anywhere
                send(anywhere, both, np.zeros(len(both), np.int64), True)
            numbers = np.array([-1 if i is None else i for i in ids], np.int64)
            rows.append(_row(anywhere, DOCS, chunk, len(ids), numbers, np.array([i is None for i in ids]), _small(sizes)))
            yield _batch(rows)
            chunk += 1

    return docs.mapInArrow(pack, PACK)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0..KEPT (0 unused) from the counts of counts n[0] = n1, ...; 1 where they aren't within (0, 1]."""
    d = np.ones(KEPT + 1)
    if n[0]:
        common = (KEPT + 1) * n[KEPT] / n[0]
        for r in range(1, KEPT + 1):
            if n[r - 1] and common < 1:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


class Unigrams:
    def __init__(self, stats: np.ndarray):
        self.n, self.v, counts = int(stats[0]), int(stats[1]), [int(x) for x in stats[2:]]
        self.d = discounts(counts)
        # Mass that the discounts leave; counts above KEPT keep theirs.
        left = sum((1 - self.d[r]) * r * counts[r - 1] for r in range(1, KEPT + 1))
        self.total = self.n if left > 0 else self.n + 1
        self.unknown = (left if left > 0 else 1.0) / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, KEPT) * (c <= KEPT)] * c / self.total, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))


class _Partition:
    """The pairs of one partition, joined: distinct pairs with training counts, their histories and their words' counts."""

    def __init__(self, batches):
        self.chunks, self.docs = [], []
        hs, ws, train, words, counts = [], [], [], [], []
        for b in batches:
            for r in range(b.num_rows):
                kind, chunk, n = (b.column(c)[r].as_py() for c in (1, 2, 3))
                blob = lambda c: b.column(c)[r].as_py()  # noqa: B023, E731
                if kind == DOCS:
                    self.docs.append((chunk, n, blob(4), blob(5), blob(6)))
                elif kind == WORDS:
                    words.append(np.frombuffer(blob(4), np.uint64))
                    counts.append(_wide(blob(5), n))
                elif kind == PAIRS:
                    hs.append(np.frombuffer(blob(4), np.uint64)[_wide(blob(6), n)])
                    ws.append(np.frombuffer(blob(5), np.uint64)[_wide(blob(7), n)])
                    train.append(_wide(blob(8), n))
                    occ = _wide(blob(9), n)
                    self.chunks.append((chunk, n, occ, _wide(blob(10), int(occ.sum()))))
        none = [np.empty(0, np.uint64)]
        h, w = np.concatenate(hs or none), np.concatenate(ws or none)
        _, at, self.inverse = np.unique(_pair(h, w), return_index=True, return_inverse=True)
        self.h, self.w = h[at], w[at]
        self.train = np.bincount(self.inverse, weights=np.concatenate(train or none), minlength=len(at)).astype(np.int64)
        words, counts = np.concatenate(words or none), np.concatenate(counts or none).astype(np.int64)
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        at = np.minimum(np.searchsorted(words, self.w), max(0, len(words) - 1))
        self.c = np.where(words[at] == self.w, counts[at], 0) if len(words) else np.zeros(len(self.w), np.int64)


SHARED = "kind int, h long, w long, v array<double>"
COUNTS, HISTORY, PAIR = range(3)


def _histories(h: np.ndarray, train: np.ndarray, p1: np.ndarray, number: np.ndarray, size: int) -> np.ndarray:
    """Per history: count, seen pairs of count 1..KEPT, unigram mass of what was seen."""
    seen = train > 0
    cols = [np.bincount(number, weights=train, minlength=size)]
    cols += [np.bincount(number, weights=train == r, minlength=size) for r in range(1, KEPT + 1)]
    cols.append(np.bincount(number, weights=np.where(seen, p1, 0), minlength=size))
    return np.stack(cols, 1)


def _shares(dealt: DataFrame, deal: _Deal, uni: Unigrams) -> DataFrame:
    """Counts of counts of pairs, statistics of frequent histories and counts of frequent pairs, summed over partitions."""

    def run(batches):
        part = _Partition(batches)
        kinds, hs, ws, vs = [COUNTS], [0], [0], [[float(np.count_nonzero(part.train == r)) for r in range(1, KEPT + 2)]]
        hot = np.flatnonzero(deal.is_hot(part.h))
        if len(hot):
            u, number = np.unique(part.h[hot], return_inverse=True)
            for x, v in zip(u.view(np.int64).tolist(), _histories(u, part.train[hot], uni.p(part.c[hot]), number, len(u)).tolist()):
                kinds.append(HISTORY), hs.append(x), ws.append(0), vs.append(v)
            both = hot[deal.is_hot_pair(part.h[hot], part.w[hot]) & (part.train[hot] > 0)]
            for x, y, c in zip(part.h[both].view(np.int64).tolist(), part.w[both].view(np.int64).tolist(), part.train[both].tolist()):
                kinds.append(PAIR), hs.append(x), ws.append(y), vs.append([float(c)])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(hs, pa.int64()), pa.array(ws, pa.int64()), pa.array(vs, pa.list_(pa.float64()))], ["kind", "h", "w", "v"])

    width = KEPT + 2
    rows = dealt.mapInArrow(run, SHARED).groupBy("kind", "h", "w").agg(F.array(*[F.coalesce(F.sum(F.get("v", F.lit(i))), F.lit(0.0)) for i in range(width)]).alias("v"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("kind", "h", "w", "v"))).alias("shared"))  # 4 x partitions of them at most


SUMS = "chunk long, kind int, n long, docs binary, a binary, b binary, c binary"


def _scored(dealt: DataFrame, shared: DataFrame, deal: _Deal, uni: Unigrams) -> DataFrame:
    """Per partition and chunk: sums of log probability, base score and known words for those documents of the chunk that have pairs here: a document
    is named once for each partition that it has pairs in, so never more often than it has words."""

    def run(batches):
        facts = None

        def plain():
            nonlocal facts
            for b in batches:
                if facts is None and b.num_rows:
                    facts = b.column(b.num_columns - 1)[0].as_py()
                yield b

        part = _Partition(plain())
        if facts is None:
            return
        d = discounts([int(x) for x in next(f["v"] for f in facts if f["kind"] == COUNTS)])
        at_hot = {f["h"]: f["v"] for f in facts if f["kind"] == HISTORY}
        pairs = {(f["h"], f["w"]): f["v"][0] for f in facts if f["kind"] == PAIR}
        p1 = uni.p(part.c)
        count = part.train.copy()
        for i in np.flatnonzero(deal.is_hot_pair(part.h, part.w)):
            count[i] = int(pairs.get((int(part.h[i : i + 1].view(np.int64)[0]), int(part.w[i : i + 1].view(np.int64)[0])), 0))
        u, number = np.unique(part.h, return_inverse=True)
        stats = _histories(part.h, part.train, p1, number, len(u))
        for i in np.flatnonzero(deal.is_hot(u)):
            stats[i] = at_hot.get(int(u[i : i + 1].view(np.int64)[0]), [0.0] * stats.shape[1])
        left = stats[:, 1 : KEPT + 1] @ ((1 - d[1:]) * np.arange(1, KEPT + 1))
        total = np.where(left > 0, stats[:, 0], stats[:, 0] + 1)  # nothing discounted: one more count for the unseen
        left = np.where(left > 0, left, 1.0)
        alpha = np.where(stats[:, 0] > 0, left / total / np.maximum(1 - stats[:, -1], 1e-300), 1.0)
        factor = np.where(count <= KEPT, d[np.minimum(count, KEPT)], 1.0)
        with np.errstate(divide="ignore"):
            score = np.log10(np.where(count > 0, factor * count / total[number], alpha[number] * p1))
        base, known = uni.base(part.c), part.c > 0

        types = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 4

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types)], [c.split()[0] for c in SUMS.split(", ")])

        at = 0
        for chunk, n, occ, docs in part.chunks:  # sums of the documents that a chunk has here, and of no others
            pair = np.repeat(part.inverse[at : at + n], occ)
            at += n
            if len(docs):
                own, number = np.unique(docs, return_inverse=True)
                s, z, k = (np.bincount(number, weights=x[pair], minlength=len(own)) for x in (score, base, known))
                yield row(chunk, PAIRS, len(own), _small(own).tobytes(), s.tobytes(), z.tobytes(), _small(k.astype(np.int64)).tobytes())
        for chunk, n, ids, nulls, sizes in part.docs:
            yield row(chunk, DOCS, n, b"", ids, nulls, sizes)

    # The totals stand in the first row of each partition. In one query with what makes them, since a second would make the shuffle of pairs anew.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return dealt.crossJoin(F.broadcast(shared)).withColumn("shared", F.when(first, F.col("shared"))).mapInArrow(run, SUMS)


def _per_document(sums: DataFrame) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()  # CHUNK words' sums at most, some 20 bytes for each word
        d = next(r for r in rows if r["kind"] == DOCS)
        score, base, known = np.zeros(d["n"]), np.zeros(d["n"]), np.zeros(d["n"], np.int64)
        for r in sorted((r for r in rows if r["kind"] == PAIRS), key=lambda r: (r["a"], r["b"])):  # the same order of adding every time
            at = _wide(r["docs"], r["n"])
            score[at] += np.frombuffer(r["a"])
            base[at] += np.frombuffer(r["b"])
            known[at] += _wide(r["c"], r["n"])
        ids = pa.array(np.frombuffer(d["a"], np.int64), mask=np.frombuffer(d["b"], bool))
        return pa.table({"doc_id": ids, "n_tokens": _wide(d["c"], d["n"]), "n_known": known, "base_score": base, "score": score})

    return sums.groupBy("chunk").applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def katz_scores(docs: DataFrame, learn, bucket_bytes: int = 18_000_000, frequent: int = 1000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``; ``learn`` is the condition for training rows.

    ``bucket_bytes`` is the text that one partition's pairs stem from; a word or pair is frequent if the sample has it ``frequent`` times
    and as often as a partition's half.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("train"), text_bytes().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // bucket_bytes))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0)

    def words(batches):
        for _, _, _, w, h, _ in _chunks(batches):
            for kind, x in ((0, w), (1, _pair(h, w))):
                u, n = np.unique(x, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(n)], ["kind", "name", "n"])

    counted = sample.select("doc_id", "train", "text").mapInArrow(words, "kind int, name long, n long").groupBy("kind", "name").agg(F.sum("n").alias("n"))
    counted = stored(counted, "katz-sample")
    seen = counted.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    named = counted.where(F.col("n") >= max(frequent, seen / (2 * parts))).select("kind", "name").collect()  # 2 * parts words and as many pairs at most
    names = [np.array([r.name for r in named if r.kind == kind], np.int64).view(np.uint64) for kind in (0, 1)]
    deal = _Deal(parts, np.unique(np.concatenate([names[0], np.array([START, END], np.uint64)])), names[1])

    table = word_table(rows.select("doc_id", "train", "text"), deal)
    facts = [np.frombuffer(bytes(r.h), np.int64) for r in table.where(F.col("kind") == STATS).select("h").collect()]  # 8 numbers a partition
    uni = Unigrams(np.sum(facts, axis=0) if facts else np.zeros(KEPT + 3, np.int64))
    dealt = table.where(F.col("kind") == WORDS).union(_packed(rows, deal)).repartitionById(parts, F.col("bucket"))
    out = _per_document(_scored(dealt, _shares(dealt, deal, uni), deal, uni))
    return out.withColumn("train_tokens", F.lit(uni.n).cast("long"))


def op6_katz_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    out = katz_scores(docs, rest != 2)
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
