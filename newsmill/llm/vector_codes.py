"""Vector compression to short codes: one small integer codebook for each part of a vector, learnt by k-means in exact integer arithmetic.

Components become integers, floor(scale * x). Each task lays its vectors down once, in chunks of CHUNK rows: for every part position the
subvectors are sorted along a Hilbert curve and cut into flat blocks of BLOCK rows, and each block keeps the box around its rows and their sum.
A round sends the codebooks to the tasks. The entry with the least distance to the far end of a block's box is sure to be near to all its rows;
how much farther another entry is than that one is linear in each component and so least at an end of the box, and entries that are
farther even there are off the block's shortlist. Where one entry is left, the block's sum counts for all of its rows; the others are compared with the
entries of their shortlist alone. Nothing is shuffled but one row of sums for each task, part, entry and
component; the chunks keep their rows' places, so the codes need no regrouping either.

Odd input: vectors that are null or hold null, NaN or infinite components are dropped; shorter vectors count as padded with zeros up
to the longest length, rounded up to a multiple of the number of parts; with fewer vectors than entries the codebooks are as short; rows that
share an id all count, and rank by their vector among the first; null ids come last. Chunks or codebooks with integers too large for
64-bit distances are computed with Python's integers, and an error that passes 2**63 - 1 is given as that. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, joined, stored

#: Vectors laid down together, and rows of a block.
CHUNK, BLOCK = 8192, 64
LIMB = 30
LONG = 2**63 - 1


class Shape(NamedTuple):
    """How vectors are cut: ``parts`` pieces of ``width`` components, each scaled by ``scale``."""

    parts: int
    width: int
    scale: int

    @property
    def narrow(self) -> int:
        """The largest magnitude whose squared distances stay below 2**63."""
        return math.isqrt(2**63 // max(1, self.width)) // 2 - 1


def kept_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite components only."""
    x = F.col(vector)
    return df.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))


# --- chunks --------------------------------------------------------------------------------------


def exact_floor(x: float, scale: int) -> int:
    """floor(scale * x) without rounding or overflow."""
    up, down = float(x).as_integer_ratio()
    return up * scale // down


def hilbert_order(v: np.ndarray) -> np.ndarray:
    """Order of the rows of ``v`` along a Hilbert curve through their bounding box (Skilling's transform of transposed axes).

    The curve has 63 bits at most: many components get few bits each, and of more than 63 only those with the widest spread count. Order
    decides how tight boxes are, never a result."""
    v = v.astype(np.float64)
    low = v.min(0)
    spread = v.max(0) - low
    spread[~np.isfinite(spread)] = 0
    axes = np.argsort(-spread, kind="stable")[:63]
    axes = axes[spread[axes] > 0]
    if not len(axes):
        return np.arange(len(v))
    bits = max(1, min(8, 63 // len(axes)))
    x = np.minimum(((v[:, axes] - low[axes]) / spread[axes] * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | ((axis >> b) & 1)
    return np.argsort(key, kind="stable")


class Chunk:
    """Subvectors by part in curve order, their places in the chunk, and each block's box and sum."""

    def __init__(self, values: np.ndarray, order: np.ndarray, low, high, sums):
        self.values, self.order, self.low, self.high, self.sums = values, order, low, high, sums
        self.rows = values.shape[1]
        starts = np.arange(0, self.rows, BLOCK)
        self.counts = np.minimum(BLOCK, self.rows - starts)

    @classmethod
    def of(cls, values: np.ndarray, order: np.ndarray) -> Chunk:
        starts = np.arange(0, values.shape[1], BLOCK)
        return cls(values, order, *(f.reduceat(values, starts, axis=1) for f in (np.minimum, np.maximum, np.add)))

    def assigned(self, part: int, book: np.ndarray):
        """(entries, blocks) for each distinct shortlist of a part's blocks; an entry off a shortlist is farther from each of the block's rows
        than one on it."""
        low, high = self.low[part][:, None, :], self.high[part][:, None, :]
        below, above = low - book[None], book[None] - high
        farthest = np.maximum(np.abs(below), np.abs(above))
        sure = (farthest * farthest).sum(2).argmin(1)[:, None, None]
        at_low, at_high = below * below, above * above  # squared distances of the box's two ends, component by component
        less = lambda d: d - np.take_along_axis(d, sure, axis=1)
        near = np.minimum(less(at_low), less(at_high)).sum(2) <= 0
        lists, which = np.unique(near, axis=0, return_inverse=True)
        for i, short in enumerate(lists):
            yield np.flatnonzero(short), np.flatnonzero(which.ravel() == i)

    def rows_of(self, blocks: np.ndarray) -> np.ndarray:
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)[None]).ravel()
        return at[at < self.rows]

    def distances(self, part: int, rows: np.ndarray, book: np.ndarray) -> np.ndarray:
        x = self.values[part][rows]
        return np.stack([((x - c) * (x - c)).sum(1) for c in book], axis=1)

    def add_sums(self, books: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add each entry's rows of this chunk and their sum to ``counts`` and ``sums`` (Python integers)."""
        for part, book in enumerate(books):
            for entries, blocks in self.assigned(part, book):
                if len(entries) == 1:
                    counts[part, entries[0]] += int(self.counts[blocks].sum())
                    sums[part, entries[0]] += self.sums[part][blocks].astype(object).sum(0)
                    continue
                rows = self.rows_of(blocks)
                best = self.distances(part, rows, book[entries]).argmin(1)
                for i, entry in enumerate(entries):
                    mine = rows[best == i]
                    if len(mine):
                        counts[part, entry] += len(mine)
                        sums[part, entry] += self.values[part][mine].sum(0).astype(object)

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) indexes of the nearest entries, and the squared distances summed over parts."""
        code = np.zeros((self.rows, len(books)), np.uint8)
        error = np.zeros(self.rows, object)
        for part, book in enumerate(books):
            for entries, blocks in self.assigned(part, book):
                rows = self.rows_of(blocks)
                d = self.distances(part, rows, book[entries])
                best = d.argmin(1)
                at = self.order[part][rows]
                code[at, part] = entries[best]
                error[at] += d[np.arange(len(rows)), best].astype(object)
        return code, error


STORED = "rows int, raw binary, kind string, places binary, low binary, high binary, sums binary"


def _packed(vectors: pa.ListArray, shape: Shape) -> dict:
    """A chunk as a row of the stored table."""
    n, wide = len(vectors), shape.parts * shape.width
    flat = np.zeros((n, wide), np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    owner = np.repeat(np.arange(n), sizes)
    flat[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy(zero_copy_only=False)
    split = flat.reshape(n, shape.parts, shape.width).transpose(1, 0, 2)
    order = np.stack([hilbert_order(p) for p in split])
    split = np.take_along_axis(split, order[:, :, None], axis=1)
    places = order.astype(np.uint16)
    most = float(np.abs(flat).max(initial=0))
    if math.isfinite(most * shape.scale) and most * shape.scale < min(shape.narrow, 2**52):
        values = np.floor(split * shape.scale)
        values = values.astype(np.int16 if np.abs(values).max(initial=0) < 2**15 - 1 else np.int32 if np.abs(values).max(initial=0) < 2**31 - 1 else np.int64)
        c = Chunk.of(values.astype(np.int64), places)
        return {"rows": n, "raw": values.tobytes(), "kind": values.dtype.str, "places": places.tobytes()} | {k: getattr(c, k).astype(np.int64).tobytes() for k in ("low", "high", "sums")}
    return {"rows": n, "raw": split.tobytes(), "kind": "exact", "places": places.tobytes(), "low": b"", "high": b"", "sums": b""}


def _unpacked(row: dict, shape: Shape) -> Chunk:
    n = row["rows"]
    places = np.frombuffer(row["places"], np.uint16).reshape(shape.parts, n)
    if row["kind"] == "exact":
        values = np.array([exact_floor(x, shape.scale) for x in np.frombuffer(row["raw"], np.float64)], object)
        return Chunk.of(values.reshape(shape.parts, n, shape.width), places)
    values = np.frombuffer(row["raw"], row["kind"]).astype(np.int64).reshape(shape.parts, n, shape.width)
    return Chunk(values, places, *(np.frombuffer(row[k], np.int64).reshape(shape.parts, -1, shape.width) for k in ("low", "high", "sums")))


def chunks(df: DataFrame, vector: str, shape: Shape, carry: list[str]) -> DataFrame:
    """The vectors of ``df`` (see :func:`kept_vectors`) in chunks, with the columns in ``carry`` as arrays c0, c1, ...; no shuffle."""
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kinds = [f.dataType for f in rows.schema.fields[:-1]]
    schema = T.StructType([T.StructField(f"c{i}", T.ArrayType(k)) for i, k in enumerate(kinds)] + list(T._parse_datatype_string(STORED).fields))

    def run(batches):
        def row(tables):
            t = pa.Table.from_batches(tables).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), c) for c in (pa.concat_arrays(t.column(i).chunks) for i in range(len(kinds)))]
            packed = _packed(pa.concat_arrays(t.column(len(kinds)).chunks), shape)
            kinds_of = {"rows": pa.int32(), "kind": pa.string()}
            return pa.RecordBatch.from_arrays(lists + [pa.array([v], kinds_of.get(k, pa.binary())) for k, v in packed.items()], names=schema.names)

        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                take = b.slice(at, CHUNK - n)
                held.append(take)
                at, n = at + take.num_rows, n + take.num_rows
                if n == CHUNK:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)

    return rows.mapInArrow(run, schema)


# --- rounds --------------------------------------------------------------------------------------


def _arrays(books: list, shape: Shape, exact: bool) -> np.ndarray:
    """(parts, entries, width), as 64-bit integers where that is exact."""
    return np.array(books, object if exact else np.int64).reshape(shape.parts, -1, shape.width)


def _exact(books: list, shape: Shape) -> bool:
    return any(abs(x) > shape.narrow for part in books for entry in part for x in entry)


def _chunks_in(batches, shape: Shape, exact: bool):
    """(batch, row, chunk), a chunk at a time."""
    for b in batches:
        for i in range(b.num_rows):
            row = {k: b.column(k)[i].as_py() for k in ("rows", "raw", "kind", "places", "low", "high", "sums")}
            c = _unpacked(row, shape)
            if exact and c.values.dtype != object:
                c = Chunk(*(x.astype(object) for x in (c.values,)), c.order, *(x.astype(object) for x in (c.low, c.high, c.sums)))
            yield b, i, c


def _round(table: DataFrame, books: list, shape: Shape, limbs: int) -> list:
    """The codebooks after one round; one row for each task and component travels."""
    exact, k = _exact(books, shape), len(books[0])
    names = [f"l{i}" for i in range(limbs)]

    def run(batches):
        counts, sums = np.zeros((shape.parts, k), object), np.zeros((shape.parts, k, shape.width), object)
        narrow, large = None if exact else _arrays(books, shape, False), _arrays(books, shape, True)
        for _, _, c in _chunks_in(batches, shape, exact):
            c.add_sums(large if c.values.dtype == object else narrow, counts, sums)
        part, entry, at = (x.ravel() for x in np.indices(sums.shape))
        flat, columns = sums.ravel(), []
        for i in range(limbs):
            last = i == limbs - 1
            columns.append(pa.array([int(x) if last else int(x) & ((1 << LIMB) - 1) for x in flat], pa.int64()))
            flat = np.array([int(x) >> LIMB for x in flat], object)
        n = pa.array([int(x) for x in counts[part, entry]], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), n, *columns], names=["part", "entry", "at", "n", *names])

    sums = table.drop(*[c for c in table.columns if c[1:].isdigit()]).mapInArrow(run, "part int, entry int, at int, n long, " + ", ".join(f"{x} long" for x in names))
    new = [[list(e) for e in part] for part in books]
    for r in sums.groupBy("part", "entry", "at").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).where("n > 0").collect():  # entries x width rows a part
        new[r.part][r.entry][r.at] = sum(r[x] << (LIMB * i) for i, x in enumerate(names)) // r.n
    return new


def fitted(table: DataFrame, start: list, shape: Shape, rounds: int, limbs: int) -> list:
    """Codebooks (part, entry, component) after ``rounds`` rounds over all chunks; entries without rows stay as they are."""
    books = start
    for _ in range(rounds):
        books = _round(table, books, shape, limbs)
    return books


def encoded(table: DataFrame, books: list, shape: Shape, carry: list[T.StructField]) -> DataFrame:
    """The carried columns of every row with ``code`` (the entries' indexes, a byte each) and ``error``."""
    exact = _exact(books, shape)
    schema = T.StructType([*carry, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches):
        narrow, large = None if exact else _arrays(books, shape, False), _arrays(books, shape, True)
        for b, i, c in _chunks_in(batches, shape, exact):
            code, error = c.codes(large if c.values.dtype == object else narrow)
            own = [b.column(f"c{j}").slice(i, 1).flatten() for j in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in code], pa.binary()), pa.array([min(LONG, int(x)) for x in error], pa.int64())], names=schema.names)

    return table.mapInArrow(run, schema)


def compressed(df: DataFrame, vector: str, order: str, carry: list[str], parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096):
    """(rows, codebooks): every kept row's ``carry`` columns with ``code`` and ``error``, stored, and the integer codebooks by part and entry.

    The codebooks start as the parts of the first ``entries`` rows by ``order`` (at most 256) and go through the driver in every round:
    parts x entries x width numbers, whatever the number of rows."""
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("entries must be from 1 to 256 and parts at least 1")
    kept = kept_vectors(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([order, vector, *carry])]), vector)
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    shape = Shape(parts, -(-longest // parts), scale)
    first = kept.orderBy(F.col(order).asc_nulls_last(), F.col(vector)).select(F.col(vector).cast("array<double>").alias("v")).limit(entries).collect()
    fields = [df.schema[c] for c in carry]
    if not first:
        empty = df.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))
        return empty, [[] for _ in range(parts)]
    full = [[exact_floor(x, scale) for x in r.v] + [0] * (parts * shape.width - len(r.v)) for r in first]
    start = [[v[p * shape.width : (p + 1) * shape.width] for v in full] for p in range(parts)]
    double = df.schema[vector].dataType.elementType not in (T.FloatType(), T.IntegerType(), T.ShortType(), T.ByteType())
    table = stored(chunks(kept, vector, shape, carry), "vector-chunks")
    books = fitted(table, start, shape, rounds, (1024 if double else 128) // LIMB + 4)
    out = stored(encoded(table, books, shape, fields), "vector-codes")
    drop_stored(table)
    return out, books


def codebooks_digest(books: list) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "vec_id", ["vec_id", "label"])
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = rows.groupBy("key").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    return joined(rows, totals, "key", ["vec_id", "code"]).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


def _op11_sql(rounds: int = 6) -> str:
    nearest = """a{i} AS MATERIALIZED (SELECT vec_id, p, any_value(s) AS s, min(struct_pack(d := d, e := e)) AS best FROM
      (SELECT vec_id, p, s, e, list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut JOIN c{i} USING (p)) GROUP BY vec_id, p)"""
    update = """c{j} AS MATERIALIZED (SELECT p, e, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT p, e, list(q ORDER BY k) AS c FROM
      (SELECT p, best.e AS e, k, ((sum(s[k]) - (sum(s[k]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS q
       FROM a{i}, range(1, len(s) + 1) t(k) GROUP BY p, best.e, k) GROUP BY p, e) m USING (p, e))"""
    steps = [nearest.format(i=0)]
    for i in range(rounds):
        steps += [update.format(i=i, j=i + 1), nearest.format(i=i + 1)]
    return f"""WITH kept AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS s FROM kept, range(8) t(p)),
    c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s AS c FROM cut
           WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
    {", ".join(steps)},
    coded AS (SELECT vec_id, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""


OP11_SQL = _op11_sql()
