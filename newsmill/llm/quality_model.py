"""Quality classifier: random Fourier features, ridge regression from summed normal equations, isotonic calibration.

Document statistics are standardised and mapped by random Fourier features, whose inner products approximate a Gaussian
kernel. Every partition of the labelled rows sums its normal equations; the sums are added and solved once. Scores of labelled
rows that the solution did not see are calibrated by pool-adjacent-violators over a fixed grid of bins.

The only things that reach the driver are of fixed size: means and deviations, a (features + 1)-squared matrix, and the grid.
All labelled rows outside the held-out fold are used, there is no sample.

Rules for odd input: null and empty texts have all statistics 0 and are scored like any text; labels that are null or have no
document are ignored; several labels of one doc_id count as their mean; rows that repeat a doc_id are each scored; a null
doc_id belongs to no fold (held_out is false) and is never learnt from; without labels, or with one label only, every score is
that label's share (0.5 without labels); other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, stored, text_bytes
from .quality_features import NAMES, features

FOLDS = 5
BINS = 1000


def fold(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text."""

    def run(batches):
        for b in pieces(batches, 500):
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return small_batches(docs).select("doc_id", text_bytes().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Fourier:
    """x -> random Fourier features of (x - mean) / deviation, with a constant and the standardised x itself in front."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int, width: float, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = r.normal(0, 1 / width, (len(mean), size))
        self.b = r.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.ones((len(x), 1)), z, np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])


def _matrix(b: pa.RecordBatch, column: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def normal_equations(rows: DataFrame, phi: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sums over ``rows`` (x, y) of phi phi' and phi y: per partition in a task, then by matrix row."""

    def run(batches):
        total = None
        for b in pieces(batches, 2000):
            if b.num_rows:
                z = phi(_matrix(b, 0))
                part = z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(t: pa.Table) -> pa.Table:
        rows = t.column("row").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return pa.table({"i": t.column("i")[:1], "row": pa.array([rows.sum(0)], pa.list_(pa.float64()))})

    parts = rows.select("x", "y").mapInArrow(run, "i int, row array<double>")
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))  # sums of sums: no group holds every partition's row
    some = salted.groupBy("i", "salt").applyInArrow(lambda t: add(t.select(["i", "row"])), "i int, row array<double>")
    sums = {r.i: r.row for r in some.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()}
    full = np.array([sums[i] for i in range(len(sums))]).reshape(len(sums), len(sums) + 1)
    return full[:, :-1], full[:, -1]


def pool(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the increasing sequence nearest to ``value`` under ``weight``."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.array([v for _, v, n in blocks for _ in range(int(n))])


def calibrate(bins: list, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw score, probability) from (bin, n, sum of raw, sum of label), smoothed by one pseudo-label at the base rate."""
    if not bins:
        return np.array([0.0, 1.0]), np.array([base, base])
    n, raw, y = (np.array(c, float) for c in zip(*((b.n, b.raw, b.y) for b in sorted(bins, key=lambda b: b.bin))))
    fit = pool(n, y / n)
    x = raw / n
    knots_x, knots_y = [], []
    for v in np.unique(fit):  # one knot per block, at its mean
        at = fit == v
        m = n[at].sum()
        knots_x.append((n[at] * x[at]).sum() / m)
        knots_y.append((v * m + base) / (m + 1))
    order = np.argsort(knots_x)
    return np.array(knots_x)[order], np.maximum.accumulate(np.array(knots_y)[order])


def score_quality(
    docs: DataFrame, labels: DataFrame, size: int = 384, width: float = 4.0, ridge: float = 1e-3, threshold: float = 0.3, seed: int = 7
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = stored(statistics(docs), "quality-stats")
    learn = labels.where("quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    rows = stored(stats.join(learn, "doc_id").where(fold() != 0).select("x", "y", fold().alias("fold")), "quality-train")
    cols = [F.col("x")[i] for i in range(len(NAMES))]
    m = rows.agg(F.count("*"), F.avg("y"), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    n, base = m[0], m[1] if m[0] else 0.5
    flat = not n or base in (0.0, 1.0)
    if not flat:
        phi = Fourier(np.array(m[2 : 2 + len(NAMES)], float), np.array(m[2 + len(NAMES) :], float), size, width, seed)
        a, c = normal_equations(rows.where("fold <> 4"), phi)
        beta = np.linalg.solve(a + ridge * max(1.0, a[0, 0] if len(a) else 0) * np.eye(len(a)), c) if len(a) else None
        flat = beta is None
    if not flat:

        def raw(batches):
            for b in pieces(batches, 2000):
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(phi(_matrix(b, 0)) @ beta), b.column(1)], ["raw", "y"])

        unseen = rows.where("fold = 4").select("x", "y").mapInArrow(raw, "raw double, y double")
        bin_ = F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) * (BINS // 3))
        bins = unseen.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), F.sum("y").alias("y")).collect()  # BINS rows at most
        knots = calibrate(bins, base)

    def score(batches):
        for b in pieces(batches, 2000):
            if flat or not b.num_rows:
                s = np.full(b.num_rows, float(base))
            else:
                r = phi(_matrix(b, 1)) @ beta
                # The calibrated value, with a hundredth of the raw one to keep order within a block.
                s = 0.99 * np.interp(r, *knots) + 0.01 * np.clip(r, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.mapInArrow(score, f"doc_id {kind}, score double")
    return out.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted")
    )


def op2_quality_model(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_quality(read("documents"), read("labels"))
