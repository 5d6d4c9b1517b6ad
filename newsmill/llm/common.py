"""Shared pieces of the corpus operators: the shared folder, word hashing, bitmap filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop_stored, new_folder, ranged, stored  # noqa: F401

#: Java form of a word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of ``rows`` rows at most in its session from now on: texts are long, and Spark, Arrow and Python each hold a
    batch, which 10,000 texts make hundreds of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


#: Rows of one key that a join may send to one task, unless they are less than a thousandth of all.
CROWD = 500


def joined(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` in which ``right`` has one row per key at most and one key may hold any share of ``left``.

    Keys with more than a thousandth of left's rows (so a thousand at most) are counted and sent to the driver; their rows are dealt out
    over several tasks by a hash of the columns in ``spread``, and right's row is repeated for each: 2,000 rows more at most.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    share = max(CROWD, (total or 0) // 1000)
    if (most or 0) <= share:
        return left.join(right, key, how)
    hot = counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("tasks"))
    hot = F.broadcast(left.sparkSession.createDataFrame(hot.collect(), hot.schema))  # a thousand rows at most
    dealt = left.join(hot, key, "left").withColumn("task", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("tasks")).cast("int"), F.lit(0))).drop("tasks")
    each = right.join(hot, key, "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tasks") - 1, F.lit(0))))).drop("tasks")
    return dealt.join(each, [key, "task"], how).drop("task")


#: Keys that are broadcast at most (about 60 bytes each).
FEW = 200_000


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` (text, not null) is not in ``gone``, a stored table of one column ``key``.

    Texts don't travel: up to FEW keys are broadcast; of more, a bitmap of fixed size picks the rows that may be in ``gone``, and only
    those are joined exactly. Columns of ``docs`` may have any name.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"))
    back = [F.col("row")[c].alias(c) for c in names]
    if gone.count() <= FEW:
        return rows.join(F.broadcast(gone), "key", "left_anti").select(*back)
    may, cannot = parted(rows, "key", gone)
    return cannot.unionByName(may.join(gone, "key", "left_anti").select("row", "key")).select(*back)


def parted(rows: DataFrame, key: str, keys: DataFrame, bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """(rows that may, rows that can't have a ``key`` of the table ``keys``), told apart in their tasks by a bitmap of 2**bits bits."""
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(keys.select(F.xxhash64(key).alias("h")), "h", bits))
    marked = small_batches(rows).select("*", F.xxhash64(key).alias("key_hash"))
    last = len(rows.columns)

    def pick(wanted: bool):
        def run(batches):
            marks = np.frombuffer(bitmap.value, np.uint8)
            for b in batches:
                hit = in_bitmap(marks, bits, b.column(last).to_numpy().view(np.uint64))
                yield b.select(list(range(last))).filter(pa.array(hit == wanted))

        return marked.mapInArrow(run, rows.schema)

    return pick(True), pick(False)


def text_bytes(col: str = "text"):
    """Text as UTF-8 bytes, null as empty; Python's bytes.split() and bytes.lower() then follow the ASCII word rule exactly."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered; emptied when it holds ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` successive entries of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that Python holds few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


# --- fixed-size bitmap filters -------------------------------------------------------------------


def bitmap_of(hashes: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of 2**bits bits in which every hash sets two: its low bits and the bits from 32 on.

    Its size is fixed by ``bits`` and not by the data, which bounds what is sent to the driver and to executors. It only
    pre-selects: whatever passes is joined exactly afterwards, so a full bitmap costs time and loses nothing.
    """
    mask = F.lit((1 << bits) - 1)
    at = F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(F.col(column), 32).bitwiseAND(mask)))
    rows = (
        hashes.select(at.alias("at"))
        .select(F.shiftright("at", 15).alias("part"), F.col("at").bitwiseAND(F.lit(32767)).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(max(1, 1 << bits >> 15) * 4096, np.uint8)
    for r in rows.collect():  # 4 KB for each 32,768 bits
        out[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.tobytes()


def in_bitmap(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the bitmap. ``bits`` is 32 at most."""

    def probe(at):
        at = at & np.uint64((1 << bits) - 1)
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    out = probe(h)
    first = np.flatnonzero(out)
    out[first] = probe(h[first] >> np.uint64(32))
    return out
