"""The vector index, and pairs of near vectors, against brute force."""

import pathlib
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsmill.operators import feed, steps, vector_index


def clustered(n, size=16, groups=12, seed=0, spread=0.25):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(groups, size))
    return [(i, [float(np.float32(x)) for x in middles[i % groups] + r.normal(scale=spread, size=size)]) for i in range(n)]


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(4)


def found(df):
    return sorted((r.query_id, r["rank"], r.id) for r in df.collect())


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(folder).rglob("*.parquet")}


def test_index(spark, tmp_path):
    rows = clustered(1200) + [(5000, [0.0] * 16), (5001, None)] + [(6000 + i, clustered(1)[0][1]) for i in range(5)]  # no direction, none, copies
    path = f"{tmp_path}/index"
    index = vector_index.build_index(frame(spark, rows), f"file://{path}", lists=20)
    assert index.vectors.count() == len(rows) - 1
    queries = frame(spark, [r for r in rows[:1200:20]] + [(9000, [0.0] * 16), (9001, None)], "query_id")
    whole = vector_index.search(index, queries, 10, 20)
    exact = feed.search_batch(frame(spark, rows), queries, 10)
    assert found(whole.where("query_id < 9000")) == found(exact.where("query_id < 9000"))  # all lists: the exact answer, ties by id
    true = {(q, i) for q, _, i in found(exact) if q < 9000}
    few = vector_index.search(index, queries, 10, 4)
    assert len({(q, i) for q, _, i in found(few) if q < 9000} & true) >= 0.9 * len(true)
    recall = {r.probes: r.recall for r in vector_index.recall_by_probes(index, queries.where("query_id < 9000"), exact.where("query_id < 9000")).collect()}
    assert recall[max(recall)] == 1 and vector_index.probes_for(index, queries.where("query_id < 9000"), exact.where("query_id < 9000"), 0.95) <= 4
    got = found(vector_index.search(index, queries, 10, 4, query_rows=7))
    assert got == found(few)  # in several rounds
    with pytest.raises(ValueError):
        vector_index.search(index, queries, 10, 0)


def test_fewer_probes_read_fewer_files(spark, tmp_path):
    index = vector_index.build_index(frame(spark, clustered(600)), f"file://{tmp_path}/index", lists=12)
    one = frame(spark, clustered(1), "query_id")

    def lists_read(probes):
        few = vector_index._listed(index, one, "query_id", probes)
        probed = sorted({r.list for r in few.collect()})
        read = index.vectors.where(F.col("list").isin(probed)).select(F.input_file_name().alias("f")).distinct().collect()
        return len({r.f.split("list=")[1].split("/")[0] for r in read}), vector_index.search(index, one, 5, probes)

    sizes = [lists_read(p)[0] for p in (1, 3, 12)]
    assert sizes[0] == 1 and sizes[1] <= 3 and sizes == sorted(sizes) and sizes[2] >= 10
    plan = lists_read(1)[1]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ (=|IN)", plan)  # folders are pruned before anything is read


def test_additions_touch_only_their_lists(spark, tmp_path):
    path = f"{tmp_path}/index"
    index = vector_index.build_index(frame(spark, clustered(600)), f"file://{path}", lists=12)
    before = files(path)
    more = [(10_000 + i, v) for i, v in clustered(600)[:240:12]]  # of one group
    vector_index.add(index, frame(spark, more), "monday")
    after = files(path)
    assert before.items() <= after.items()
    new = {f.split("list=")[1].split("/")[0] for f in set(after) - set(before)}
    assert 1 <= len(new) <= 3 and index.vectors.count() == 620
    vector_index.add(index, frame(spark, more), "monday")  # again
    assert index.vectors.count() == 620 and sorted(r.id for r in index.vectors.where("run = 'monday'").collect()) == [i for i, _ in more]


def test_index_of_few_and_no_vectors(spark, tmp_path):
    none = vector_index.build_index(frame(spark, [(1, None)]).where("id < 0"), f"file://{tmp_path}/none")
    assert len(none.centroids) == 1
    one = vector_index.build_index(frame(spark, [(1, [1.0, 0.0])]), f"file://{tmp_path}/one")
    assert found(vector_index.search(one, frame(spark, [(7, [0.5, 0.5])], "query_id"), 3, 1)) == [(7, 1, 1)]


def pairs_brute(rows, least):
    ids = [i for i, v in rows if v and any(v)]
    x = np.array([v for _, v in rows if v and any(v)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(x @ x.T >= least)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(a, b) if i != j}


@pytest.mark.parametrize("rows", [4096, 100, 7])
def test_near_vectors(spark, rows):
    data = clustered(300, spread=0.1) + [(900, [0.0] * 16), (901, None)]
    got = [(r.a, r.b) for r in steps.near_vectors(frame(spark, data), 0.9, rows=rows).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_brute(data, 0.9)


def test_similar_vectors(spark):
    data = clustered(400, size=32, groups=80, spread=0.08) + [(900 + i, [1.0] * 32) for i in range(60)] + [(990, [0.0] * 32)]
    want = pairs_brute(data, 0.9)
    for rows in (2048, 16):  # crowded buckets in blocks
        got = [(r.a, r.b) for r in steps.similar_vectors(frame(spark, data), 0.9, rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want) > 500
    assert steps.plane_recall(0.9, 12, 24) > 0.95 and steps.plane_recall(1.0, 12, 24) == 1
    assert steps.similar_vectors(frame(spark, data).limit(0), 0.9).count() == 0


def test_titles_are_embedded_once(spark, tmp_path):
    import glob
    import os

    from newsmill import articles_run

    folder = str(tmp_path)

    def embed(rows):
        from newsmill.models import hashed_embedding

        with open(f"{folder}/seen-{os.getpid()}", "a") as f:
            f.write("".join(f"{t}\n" for t in rows.text))
        return hashed_embedding(rows)

    new = spark.createDataFrame([(f"title {i}", f"u{i}") for i in range(100)], "title string, url string")
    old = spark.createDataFrame([(f"title {i}", f"k{i}") for i in range(0, 100, 2)], "title string, url string")
    left = articles_run.without_known_stories(new, old, embed)
    assert sorted(r.url for r in left.collect()) == sorted(f"u{i}" for i in range(1, 100, 2))
    seen = [x for f in glob.glob(f"{folder}/seen-*") for x in open(f).read().split("\n") if x]
    assert len(seen) == 150  # 100 new titles and 50 known ones


def test_placing_holds_no_large_matrix(spark, tmp_path):
    rows = pd.DataFrame({"id": range(5000), "embedding": [np.ones(4, np.float32)] * 5000})
    assert all(len(b) * 4096 <= vector_index.CELLS for b in vector_index._tiles([rows], 4096))
    assert all(len(b) * 700 <= vector_index.ROWS for b in vector_index._tiles([rows], 700, 700))
    assert sum(len(b) for b in vector_index._tiles([rows], 4096)) == 5000
    # What a search sends to a task: each query once, its lists as bits.
    index = vector_index.build_index(frame(spark, clustered(600)), f"file://{tmp_path}/index", lists=20)
    asked = vector_index._asked(index, frame(spark, clustered(40), "query_id"), 20).collect()
    assert len(asked) == 40 and all(len(r.lists) == 3 and np.unpackbits(np.frombuffer(r.lists, np.uint8)).sum() == len(index.centroids) for r in asked)


def test_stories_are_compared_in_tiles():
    r = np.random.default_rng(3)
    q, x = r.normal(size=(4096, 16)), r.normal(size=(10_000, 16))
    q, x = (v / np.linalg.norm(v, axis=1)[:, None] for v in (q, x))
    want = np.array([(x @ v >= 0.8).any() for v in q])
    tracemalloc.start()
    got = steps.resembled(q, np.zeros(len(q), bool), x, 0.8)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and 0 < want.sum() < len(q)
    assert held < 32e6  # all similarities have 328 MB
    assert steps.resembled(q, ~want, x, 0.8).all()


def test_recall_ranks_only_lists_with_neighbours(spark, tmp_path, monkeypatch):
    data = clustered(600) + [(5000, [0.0] * 16)]
    index = vector_index.build_index(frame(spark, data), f"file://{tmp_path}/index", lists=12)
    queries = frame(spark, clustered(600)[::30], "query_id")
    exact = feed.search_batch(frame(spark, data), queries, 10)
    of = {r.id: r.list for r in index.vectors.select("id", "list").collect()}
    turn = {(r.query_id, r.list): r["rank"] + 1 for r in vector_index._listed(index, queries, "query_id", 12).collect()}
    at = sorted(turn[r.query_id, of[r.id]] for r in exact.collect())
    monkeypatch.setattr(vector_index, "_listed", None)  # no row for each query and list
    got = {r.probes: r.recall for r in vector_index.recall_by_probes(index, queries, exact).collect()}
    assert got == {p: pytest.approx(sum(a <= p for a in at) / len(at)) for p in set(at)}


def test_centroids_are_learnt_by_several_tasks(spark, tmp_path, monkeypatch):
    from pyspark.ml.clustering import KMeans

    seen, fit = [], KMeans.fit

    def watched(self, rows):
        seen.append(rows.rdd.glom().map(len).collect())
        return fit(self, rows)

    monkeypatch.setattr(KMeans, "fit", watched)
    monkeypatch.setattr(vector_index, "LEARNT", 100, raising=False)
    index = vector_index.build_index(frame(spark, clustered(1200)), f"file://{tmp_path}/index", lists=12)
    assert len(seen[0]) == 12 and sum(seen[0]) == 1200 and max(seen[0]) < 200
    assert index.vectors.count() == 1200
    vector_index.build_index(frame(spark, clustered(1200)), f"file://{tmp_path}/sampled", lists=12, sample=300)
    assert len(seen[1]) == 3 and sum(seen[1]) == 300
