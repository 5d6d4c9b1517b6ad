"""MinHash near-duplicates with exact confirmation, and their connected components.

1. Each text becomes its set of word shingles, hashed to 64 bits, with ``n_hashes`` universal hash minima. Texts with the same
   word sequence form one class from here on.
2. Bands of ``rows_per_band`` minima give buckets. At a similarity of 0.85 a pair misses all of 20 bands of 4 with a
   probability of 4e-7. Bucket names alone are counted first; a bitmap of fixed size then picks the rows of repeated ones.
3. A bucket's members are compared with its pivot, the member whose buckets are fullest over all bands (in a group of
   near copies that is the text they derive from): as many pairs as members. Members that are in one component after
   that need no more comparing.
4. What is left (members of one bucket that are still in different components) is compared in blocks of ``BLOCK`` members or ``BLOCK_BYTES``
   of sets, pair by pair inside a task, which returns links only.
5. A pair passes if its minima agree within ``SLACK`` standard deviations of what its similarity makes likely, and is confirmed on
   the full shingle sets.
6. Components come from large-star and small-star over the confirmed links.

A bucket, a pivot, a component or a text with many copies may hold any share of the rows: joins on them deal it out over tasks.

Rules for odd input: null or empty texts, and texts without words, have no shingles, are linked with nothing and are kept;
texts shorter than a shingle have their whole word sequence as one; a null doc_id counts as larger than any other, and rows
with null ids and equal words share a null component and are kept if no row with an id is in it; rows that repeat a doc_id are
kept or dropped together; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bitmap_of, drop_stored, in_bitmap, joined, mix, pieces, small_batches, stored, text_bytes, windows
from .components import components

BLOCK, BLOCK_BYTES = 512, 16_000_000  # members and bytes of sets that are compared at a time
MEMORY = 150_000  # words that a task remembers
BITS, BUCKET_BITS = 24, 27
#: Minima that may disagree with a pair's expected agreement before it is thrown out, in standard deviations.
SLACK = 5.0


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def _words(text: bytes, hashes: WordHashes) -> tuple[list[bytes], np.ndarray]:
    words = text.lower().split()
    return words, hashes.of(words)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a word-hash sequence; a shorter sequence is one shingle."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(windows(h, min(k, len(h))) ^ (np.uint64(len(h)) if len(h) < k else np.uint64(0)))


def sketches(docs: DataFrame, k: int, n_hashes: int) -> DataFrame:
    """doc_id, row_key (both as given), key (of the word sequence), n (set size), sig (n_hashes 32-bit minima; null without shingles)."""
    a, b = _coefficients(n_hashes)

    def run(batches):
        hashes = WordHashes(MEMORY)
        for batch in pieces(batches, 300):
            keys, sets = [], []
            for t in batch.column(1).to_pylist():
                words, h = _words(t, hashes)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sets.append(shingle_set(h, k))
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            sig = np.empty((len(full), n_hashes), ">u4")
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                for i in range(n_hashes):
                    sig[:, i] = np.minimum.reduceat((every * a[i] + b[i]) >> np.uint64(32), starts)
            sigs = [None] * len(n)
            for row, i in zip(sig, full):
                sigs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(n), pa.array(sigs, pa.binary())], ["doc_id", "row_key", "key", "n", "sig"]
            )

    return docs.select("doc_id", text_bytes().alias("text"), "row_key").mapInArrow(run, "doc_id long, row_key string, key binary, n long, sig binary")


def band_names(sig: np.ndarray, rows_per_band: int) -> np.ndarray:
    """A 64-bit name for each band of each row of minima."""
    v = sig.astype(np.uint64)
    out = np.empty((len(v), v.shape[1] // rows_per_band), np.uint64)
    for i in range(out.shape[1]):
        out[:, i] = i + 1
        for r in range(rows_per_band):
            out[:, i] = mix(out[:, i] * np.uint64(0x9E3779B97F4A7C15) + v[:, i * rows_per_band + r])
    return out


def _members(sketched: DataFrame, n_hashes: int, rows_per_band: int) -> DataFrame:
    """Stored table of bucket, band, key, size (of the bucket, in classes) for buckets of two or more classes."""

    def names(b):
        sigs = b.column(1).to_pylist()
        return band_names(np.frombuffer(b"".join(sigs), ">u4").reshape(-1, n_hashes), rows_per_band) if sigs else np.empty((0, n_hashes // rows_per_band), np.uint64)

    def count(batches):
        for b in batches:
            x = names(b)
            ids = np.array([int.from_bytes(k[:8], "little", signed=True) for k in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel().view(np.int64)), pa.array(np.repeat(ids, x.shape[1]))], ["bucket", "id"])

    rows = sketched.where("n > 0").select("key", "sig")
    repeated = rows.mapInArrow(count, "bucket long, id long").groupBy("bucket").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("bucket")
    shared = sketched.sparkSession.sparkContext.broadcast(bitmap_of(repeated, "bucket", BUCKET_BITS))

    def pick(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            x = names(b)
            row, band = np.nonzero(in_bitmap(bits, BUCKET_BITS, x.ravel()).reshape(x.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[row, band].view(np.int64)), pa.array(band.astype(np.int32)), b.column(0).take(pa.array(row))], ["bucket", "band", "key"]
            )

    candidates = stored(rows.mapInArrow(pick, "bucket long, band int, key binary").distinct(), "near-candidate")
    sizes = candidates.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(joined(candidates, sizes, "bucket", ["key"]).select("bucket", "band", "key", "size"), "near-member")
    drop_stored(candidates)
    return members


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """key, set (sorted 64-bit hashes) for the classes in ``nodes`` (key, doc): texts are read again, and a bitmap of fixed
    size spares most others the work before the exact join."""
    doc_hash = F.xxhash64(F.col("doc"))
    bitmap = bitmap_of(nodes.select(doc_hash.alias("h")), "h", BITS)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        hashes = WordHashes(MEMORY)
        for batch in pieces(batches, 300):
            hit = in_bitmap(bits, BITS, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            keys, sets = [], []
            for t in batch.column(0).filter(pa.array(hit)).to_pylist():
                words, h = _words(t, hashes)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sets.append(shingle_set(h, k).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "set"])

    found = docs.select(text_bytes().alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("h")).mapInArrow(run, "key binary, set binary")
    return found.join(nodes.select("key"), "key", "left_semi").groupBy("key").agg(F.first("set").alias("set"))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _least_agreement(n_hashes: int, percent: int) -> int:
    p = percent / 100
    return int(n_hashes * p - SLACK * (n_hashes * p * (1 - p)) ** 0.5)


def _confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, n_hashes: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose minima agree and whose sets are similar; sets travel only for pairs that pass the minima."""
    least = _least_agreement(n_hashes, percent)

    def by_sets(batches):
        for x in pieces(batches, 200):
            ok = [_linked(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent) for s, t in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_())))

    sig = nodes.select("key", "sig")
    same = F.filter(F.sequence(F.lit(0), F.lit(n_hashes - 1)), lambda i: F.col("sa").substr(4 * i + 1, F.lit(4)) == F.col("sb").substr(4 * i + 1, F.lit(4)))
    with_a = joined(pairs, sig.toDF("a", "sa"), "a", ["b"])
    likely = stored(with_a.join(sig.toDF("b", "sb"), "b").where(F.size(same) >= least).select("a", "b"), "near-likely")
    both = joined(likely, sets.toDF("a", "ta"), "a", ["b"]).join(sets.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(by_sets, "a binary, b binary")


def _open(members: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component, with their component's root and the number of blocks that the bucket needs."""
    rooted = stored(members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")).join(sizes, "key"), "near-rooted")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.sum("bytes").alias("bytes"), F.count("*").alias("now")).where("x <> y")
    blocks = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("now") / BLOCK)).cast("int")
    return joined(rooted.drop("bytes"), stored(mixed.select("bucket", blocks.alias("blocks")), "near-mixed"), "bucket", ["key"])


def _blocks(opened: DataFrame, nodes: DataFrame, sets: DataFrame, n_hashes: int, per_band: int, percent: int) -> DataFrame:
    """All pairs of different components within a bucket, block by block; only confirmed links leave a task."""
    least = _least_agreement(n_hashes, percent)
    n = F.col("blocks")
    mine = F.pmod(F.xxhash64("key"), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    rows = (
        opened.select("bucket", "band", "key", "root", mine.alias("mine"), other.alias("other"))
        .select("bucket", "band", "key", "root", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .join(nodes.select("key", "sig"), "key")
        .join(sets, "key")
    )

    def run(t: pa.Table) -> pa.Table:
        keys, roots, mine = (t.column(c).to_pylist() for c in ("key", "root", "mine"))
        band, i, j = (t.column(c)[0].as_py() for c in ("band", "i", "j"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), ">u4").reshape(-1, n_hashes)
        sets_ = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
        parent = {r: r for r in roots}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        in_j = np.array(mine) == j
        for x in range(len(keys)):
            if i != j and mine[x] != i:
                continue
            like = _agree(sig, sig[x]) >= least
            for q in range(band):  # pairs that share an earlier band are compared there
                like &= ~(sig[:, q * per_band : (q + 1) * per_band] == sig[x, q * per_band : (q + 1) * per_band]).all(1)
            if i == j:
                like[: x + 1] = False
            else:
                like &= in_j
            for y in np.flatnonzero(like):
                rx, ry = root(roots[x]), root(roots[y])
                if rx != ry and _linked(sets_[x], sets_[y], percent):
                    parent[rx] = ry
                    out.append((keys[x], keys[y]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, n_hashes: int = 80, rows_per_band: int = 4, row_key: Column | None = None) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept for every row of ``docs``; doc_id must be an integer.

    Links: 100 * |A and B| >= percent * |A or B|. component_id is the least doc_id that can be reached. ``row_key`` (text) is carried
    along for callers that must tell rows of one doc_id apart.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(None) if row_key is None else row_key).cast("string").alias("row_key"))
    sk = stored(sketches(docs, k, n_hashes), "near-sketch")
    members = _members(sk, n_hashes, rows_per_band)
    classes = sk.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))  # copies fall together before the shuffle
    shared = stored(classes.join(members.select("key").distinct(), "key", "left_semi"), "near-shared")
    sets = stored(_sets(docs, shared, k), "near-set")

    weights = members.groupBy("key").agg(F.sum("size").alias("weight"))
    pivots = members.join(weights, "key").groupBy("bucket").agg(F.max_by("key", F.struct("weight", "key")).alias("pivot"))
    against = joined(members, stored(pivots, "near-pivot"), "bucket", ["key"]).where("key <> pivot")
    pairs = stored(against.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "near-pair")
    links = stored(_confirm(pairs, shared, sets, n_hashes, percent), "near-link")
    roots = components(links)
    opened = stored(_open(members.select("bucket", "band", "key"), roots, sets.select("key", F.octet_length("set").alias("bytes"))), "near-open")
    if not opened.isEmpty():
        more = stored(_blocks(opened, shared, sets, n_hashes, rows_per_band, percent), "near-link")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    for done in (members, sets, shared, pairs, opened):
        drop_stored(done)

    nodes = sk.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc"))
    linked = stored(roots.withColumnRenamed("node", "key").union(roots.select("root", "root").distinct()).join(nodes, "key"), "near-linked")
    least = linked.groupBy("root").agg(F.min("doc").alias("component"))
    placed = joined(linked.select("key", "root"), least, "root", ["key"]).select("key", "component")
    place = stored(nodes.join(placed.withColumn("linked", F.lit(True)), "key", "left").select("key", F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc")).alias("component")), "near-place")
    out = joined(sk.select("doc_id", "row_key", "key", "n"), place, "key", ["doc_id", "row_key"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")


#: Exact: shingle sets, all pairs that share a shingle, and the closure of the links.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 85 * (x.n + y.n - m)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT b, root FROM r JOIN links ON node = a),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON doc_id = node
"""
