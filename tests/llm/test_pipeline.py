"""The stages, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline as p
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.llm import line_crf, secrets
from newsmill.llm.common import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    out = {}
    for name, stage in p.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), f"test-{name}")
        out[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[: len(columns)] == columns and docs.count() <= before.count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    chain = line_crf.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    judge = line_crf._Judge(chain, 0.5)
    assert set(out["quality_rules"]) == {i for i, r in given.items() if judge((r.text or "").encode())[-1]}

    from test_documents import near_brute

    want = near_brute([(i, r.text) for i, r in out["quality_rules"].items()], k=5, percent=80)
    assert set(out["near_dedup"]) == {d for d, _, _, kept in want if kept}
    assert set(out["decontamination"]) <= set(out["near_dedup"])
    bench = [r.text.encode().lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, r in out["near_dedup"].items():
        if any(b in r.text.encode().lower() for b in bench):
            assert i not in out["decontamination"]
    assert set(out["secret_scan"]) == set(out["decontamination"])
    left = secrets.report(spark.createDataFrame([(i, r.text) for i, r in out["secret_scan"].items()], "doc_id long, text string"))
    assert left.agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0
    assert set(out["source_mix"]) <= set(out["secret_scan"])
    assert p.run(spark, sf).count() == len(out["source_mix"])


@pytest.fixture(scope="module")
def odd_folder(spark, sf, tmp_path_factory):
    """Nulls, empty texts, repeated rows and ids, copies, a benchmark passage, a secret; columns whose names the stages use themselves."""
    r = np.random.default_rng(3)
    prose = lambda n: " ".join(f"word{i}" for i in r.integers(0, 5000, n)) + "."
    one, two = prose(120), prose(200)
    passage = " ".join(f"item{i}" for i in range(30))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, one, "a"), (5, one, "b"), (5, one, "b"), (None, one, "a"), (None, None, None), (6, one + " tail", None), (7, two, "a"),
            (8, prose(60) + " " + passage + " " + prose(60), "a"), (9, prose(90) + " password = hunter22", "a"), (10, prose(20_000), "b"), (11, "### $$$ " * 40, "c")]
    rows = [(i, t, "en", s, None if t is None else len(t), "c", "k", True, "key", "row", 7, 8, "of", "h") for i, t, s in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, copy string, copy_key string, dirty boolean, key string, row string, mix_copies int, size int, of string, h string"
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (11, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_on_odd_tables(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    ids = lambda df: Counter(x.doc_id for x in df.collect())
    left = dict(p.STAGES)
    kept = stored(left["quality_rules"](spark, docs, odd_folder), "odd")
    assert ids(kept) == Counter([4, 5, 5, None, 6, 7, 8, 9, 10])
    kept = stored(left["near_dedup"](spark, kept, odd_folder), "odd")
    assert ids(kept) == Counter([4, 7, 8, 9, 10])
    kept = stored(left["decontamination"](spark, kept, odd_folder), "odd")
    assert ids(kept) == Counter([4, 7, 9, 10])
    kept = stored(left["secret_scan"](spark, kept, odd_folder), "odd")
    assert kept.columns == docs.columns and kept.where("doc_id = 9").first().text.endswith(" [SECRET]")
    assert kept.where("doc_id = 9").first().n_chars == len(kept.where("doc_id = 9").first().text)
    mixed = left["source_mix"](spark, kept, odd_folder)
    assert set(ids(mixed)) <= {4, 7, 9, 10} and "mix_words" in mixed.columns
    whole = p.run(spark, odd_folder)
    assert sorted(map(repr, whole.select(*mixed.columns).collect())) == sorted(map(repr, mixed.collect()))
    for name, stage in p.STAGES:  # each alone on the odd table, and on none
        out = stage(spark, docs, odd_folder)
        assert out.count() <= docs.count() and set(docs.columns) <= set(out.columns), name
        assert stage(spark, docs.limit(0), odd_folder).count() == 0, name


def test_rows_that_are_gone_in_great_number(spark, monkeypatch):
    """Beyond what is broadcast, a bitmap picks the rows that are joined: the same rows stay."""
    from newsmill.llm import common

    docs = spark.createDataFrame([(i % 300, f"t{i % 300}", "x", "y") for i in range(900)] + [(None, None, None, None)], "doc_id long, text string, key string, h string")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    gone = stored(docs.where("doc_id % 3 = 0").select(key.alias("key")).distinct(), "gone")
    want = sorted(repr(r) for r in docs.where("doc_id is null or doc_id % 3 > 0").collect())
    assert sorted(repr(r) for r in common.without(docs, key, gone).collect()) == want
    monkeypatch.setattr(common, "FEW", 0)
    assert sorted(repr(r) for r in common.without(docs, key, gone).collect()) == want


def test_joins_with_a_crowded_key(spark, monkeypatch):
    from newsmill.llm import common

    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(2000)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(k, k * 10) for k in range(5)], "k int, w int")
    for how in ("inner", "left"):
        want = sorted(repr(r) for r in left.join(right, "k", how).select("k", "v", "w").collect())
        for crowd in (10**9, 50):
            monkeypatch.setattr(common, "CROWD", crowd)
            assert sorted(repr(r) for r in common.joined(left, right, "k", ["v"], how).select("k", "v", "w").collect()) == want
