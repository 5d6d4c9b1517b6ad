"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Counting rules come first and can reject a document alone. Of the others, every line that has a word is labelled by Viterbi
decoding, and the document is kept if content lines hold at least ``share`` of its words.

The field has two states, emissions linear in a few line statistics, and transition and start weights. It is trained by
maximum a-posteriori likelihood on a bounded sample of labelled documents (``train_docs`` documents of smallest id hash, at
most ``train_lines`` lines of each) with weak line labels: lines of low-quality documents, and lines that occur in
``shared_docs`` or more different texts of all documents, are boilerplate; the rest is content. Weights are drawn to ``PRIOR``, which is
also what decides where there are no labels. Labelling itself reads every line of every text.

Rules for odd input: a null or empty text has zero counts and fails the base rules (fewer than 20 words); labels that are null
or have no document are ignored; repeated rows are each judged; ids are not read for the verdict; columns of any name and type
pass through ``keep_content`` unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, pieces, small_batches, text_bytes, windows

MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
_SYMBOLS = b"#*$%&|<>"
_MORE = b"#*$%&|<>!{}[]~^=+_\\@"
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_CONTINUED = bytes(range(128, 192))

#: Line statistics and the weight towards content that each has before training.
PRIOR = {
    "constant": 1.0,
    "log_words": 0.3,
    "symbols": -6.0,
    "upper": -3.0,
    "bars": -4.0,
    "digits": -2.0,
    "ends_in_stop": 0.5,
    "distinct": 1.0,
    "repeat_next": -4.0,
    "seen_before": -2.0,
    "one_or_two_words": -0.2,
    "symbol_ends": -3.0,
}
PRIOR_EDGES = np.array([[0.8, -0.8], [-0.8, 0.8]])


def line_statistics(line: bytes, words: list[bytes], seen: bool) -> list[float]:
    n, size = len(words), len(line)
    letters = sum(map(len, words))
    return [
        1.0,
        math.log1p(n),
        (size - len(line.translate(None, _MORE))) / letters,
        (size - len(line.translate(None, _UPPER))) / letters,
        line.count(b"|") / n,
        (size - len(line.translate(None, _DIGIT))) / letters,
        float(words[-1][-1] in b".!?:"),
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float(seen),
        float(n < 3),
        sum(w[-1] in b"#*$%&|<>!" for w in words) / n,
    ]


class Chain:
    """The trained field. State 1 is content; emissions of state 0 are 0."""

    def __init__(self, w: np.ndarray, edges: np.ndarray, start: np.ndarray):
        self.w, self.edges, self.start = w, edges, start

    @classmethod
    def prior(cls) -> Chain:
        return cls(np.array(list(PRIOR.values())), PRIOR_EDGES.copy(), np.zeros(2))

    def decode(self, emit: list[float]) -> list[bool]:
        """The most likely labels; of equally likely ones the first found with content preferred."""
        (e00, e01), (e10, e11) = self.edges.tolist()
        s0, s1 = self.start[0], self.start[1] + emit[0]
        back = []
        for e in emit[1:]:
            a, b, c, d = s0 + e00, s1 + e10, s0 + e01, s1 + e11
            back.append((b >= a, d >= c))
            s0, s1 = (b if b >= a else a), (d if d >= c else c) + e
        state = s1 >= s0
        out = [state]
        for to0, to1 in reversed(back):
            state = to1 if state else to0
            out.append(state)
        return out[::-1]


def train(chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.1, l2: float = 1.0) -> Chain:
    """Maximum a-posteriori weights for (statistics per line, label per line) chains: forward-backward over all chains at once."""
    c = Chain.prior()
    if not chains:
        return c
    n, longest, width = len(chains), max(len(y) for _, y in chains), len(PRIOR)
    x, y, mask = np.zeros((n, longest, width)), np.zeros((n, longest), int), np.zeros((n, longest))
    for i, (xs, ys) in enumerate(chains):
        x[i, : len(ys)], y[i, : len(ys)], mask[i, : len(ys)] = xs, ys, 1
    at = np.arange(n)
    params, prior = [c.w, c.edges, c.start], [c.w.copy(), c.edges.copy(), c.start.copy()]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold_edges = np.zeros((2, 2))
    np.add.at(gold_edges, (y[:, :-1][mask[:, 1:] > 0], y[:, 1:][mask[:, 1:] > 0]), 1)
    gold_start = np.bincount(y[:, 0], minlength=2).astype(float)
    for step in range(1, steps + 1):
        emit = np.stack([np.zeros((n, longest)), x @ c.w], -1)
        f = np.empty((n, longest, 2))
        b = np.zeros((n, longest, 2))
        f[:, 0] = c.start + emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(f[:, t - 1, :, None] + c.edges, axis=1) + emit[:, t]
            f[:, t] = np.where(mask[:, t, None] > 0, new, f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(c.edges + (emit[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
            b[:, t] = np.where(mask[:, t + 1, None] > 0, new, b[:, t])
        z = np.logaddexp.reduce(f[:, -1], axis=1)
        p1 = np.exp(f[:, :, 1] + b[:, :, 1] - z[:, None]) * mask
        pair = np.exp(f[:, :-1, :, None] + c.edges + (emit[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        p0 = np.exp(f[:, 0] + b[:, 0] - z[:, None])
        grads = [((y * mask - p1)[:, :, None] * x).sum((0, 1)), gold_edges - pair.sum((0, 1)), gold_start - p0.sum(0)]
        for k, (p, q, g) in enumerate(zip(params, prior, grads)):
            g = (g - l2 * (p - q)) / len(at)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return c


def _lines(text: bytes):
    """(line, words, seen before) of the lines that have a word."""
    seen = set()
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            yield line, words, line in seen
            seen.add(line)


def _shared_lines(docs: DataFrame, lines: np.ndarray, least: int, most: int = 50_000) -> np.ndarray:
    """Those of ``lines`` (hashes) that occur in ``least`` or more documents of different text, of all documents.

    A task sends at most ``least`` text hashes for a line, which is all that the decision needs: a task that has more has enough
    alone. It sends what it has whenever it holds ``most`` hashes, so a common line costs neither memory nor a long task.
    """
    wanted = set(lines.tolist())

    def run(batches):
        found, held = {}, 0

        def out():
            line = np.array([h for h, ts in found.items() for _ in ts], np.uint64).view(np.int64)
            text = np.array([t for ts in found.values() for t in ts], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(line), pa.array(text)], ["line", "text"])

        for b in pieces(batches, 500):
            for text in b.column(0).to_pylist():
                hits = wanted.intersection(map(xxhash.xxh3_64_intdigest, text.split(b"\n")))
                t = xxhash.xxh3_64_intdigest(text) if hits else 0
                for h in hits:
                    ts = found.setdefault(h, set())
                    if len(ts) < least and t not in ts:
                        ts.add(t)
                        held += 1
            if held >= most:
                yield out()
                found, held = {}, 0
        yield out()

    pairs = small_batches(docs).select(text_bytes().alias("text")).mapInArrow(run, "line long, text long")
    rows = pairs.groupBy("line").agg(F.count_distinct("text").alias("n")).where(F.col("n") >= least).select("line").collect()  # as many as lines at most
    return np.array([r.line for r in rows], np.int64).view(np.uint64)


def training_chains(docs: DataFrame, labels: DataFrame, train_docs: int = 1500, train_lines: int = 200, shared_docs: int = 10) -> list[tuple[np.ndarray, np.ndarray]]:
    """(statistics per line, weak label per line) of each document of the sample."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    sample = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches):
        for b in pieces(batches, 100):
            lines = [[z for _, z in zip(range(train_lines), _lines(t))] for t in b.column(1).to_pylist()]
            x = [[v for z in zs for v in line_statistics(*z)] for zs in lines]
            h = [np.array([xxhash.xxh3_64_intdigest(z[0]) for z in zs], np.uint64).view(np.int64) for zs in lines]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float32())), pa.array(h, pa.list_(pa.int64()))], ["doc_id", "q", "x", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, q int, x array<float>, h array<long>").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # train_docs rows at most
    rows = [(r.q, np.array(r.x, float).reshape(-1, len(PRIOR)), np.array(r.h, np.int64).view(np.uint64)) for r in got if r.h]
    content = [h for q, _, h in rows if q == 1]
    shared = _shared_lines(docs, np.unique(np.concatenate(content)), shared_docs) if content else np.empty(0, np.uint64)
    return [(x, ((q == 1) & ~np.isin(h, shared)).astype(int)) for q, x, h in rows]


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 1500, train_lines: int = 200, shared_docs: int = 10) -> Chain:
    return train(training_chains(docs, labels, train_docs, train_lines, shared_docs))


def _repeated_words(h: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    w = windows(h, WINDOW)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h) + 1, int)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


class _Judge:
    def __init__(self, chain: Chain, share: float):
        self.chain, self.share, self.hashes = chain, share, WordHashes()

    def __call__(self, text: bytes) -> tuple:
        words = text.split()
        n = len(words)
        letters = b"".join(words)
        chars = len(letters.translate(None, _CONTINUED))
        symbols = len(letters) - len(letters.translate(None, _SYMBOLS))
        lines = list(_lines(text))
        dups = sum(seen for _, _, seen in lines)
        repeated = _repeated_words(self.hashes.of(words)) if n > WINDOW else 0
        failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
        content = 0.0
        if lines:
            emit = (np.array([line_statistics(*z) for z in lines]) @ self.chain.w).tolist()
            content = sum(len(z[1]) for z, c in zip(lines, self.chain.decode(emit)) if c) / n
        return n, chars, symbols, dups, repeated, failed, content, not failed and content >= self.share


def judge(docs: DataFrame, chain: Chain, share: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, content_share and kept for every row."""
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches):
        one = _Judge(chain, share)
        for b in pieces(batches, 500):
            rows = list(map(one, b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def keep_content(docs: DataFrame, chain: Chain, share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    at = docs.columns.index("text")

    def run(batches):
        one = _Judge(chain, share)
        for b in pieces(batches, 500):
            texts = b.column(at).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array([one(t or b"")[-1] for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
