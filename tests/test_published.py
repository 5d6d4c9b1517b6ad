"""Published tables, the bucketed history and its filter."""

import re

import pytest
from pyspark.sql import functions as F

from newsmill.operators import history, state
from newsmill.sources import sinks
from newsmill.sources.published import Conflict, Published


@pytest.fixture
def table(spark, tmp_path):
    return Published(spark, f"file://{tmp_path}/t")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_append_replace_and_old_versions(spark, table):
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.append(spark.range(3), "monday") == 1
    assert table.append(spark.range(3, 5), "tuesday") == 2
    assert table.append(spark.range(3, 5), "tuesday") == 2 and ids(table.read()) == [0, 1, 2, 3, 4]  # a repeated run adds nothing
    assert table.replace(table.read().where("id > 1"), "wednesday") == 3  # from the table itself
    assert ids(table.read()) == [2, 3, 4] and ids(table.read(2)) == [0, 1, 2, 3, 4] and ids(table.read(1)) == [0, 1, 2]
    assert table.append(spark.range(9, 10).withColumn("more", F.lit("x")), "thursday") == 4
    assert sorted(map(tuple, table.read().collect()), key=str) == [(2, None), (3, None), (4, None), (9, "x")]
    with pytest.raises(ValueError):
        table.append(spark.range(1).select(F.col("id").cast("string")))
    assert table.replace(spark.range(0), "empty") == 5 and ids(table.read()) == []
    table.append(spark.range(7, 8))
    table.compact()
    before = ids(table.read())
    gone = table.vacuum(keep=1)
    assert before == ids(table.read()) == [7] and len(gone) >= 5 and len(table.versions()) == 1


def test_failed_runs_leave_the_old_version(spark, table):
    table.replace(spark.range(3), "good")
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        table.replace(broken, "bad")
    assert ids(table.read()) == [0, 1, 2] and table.versions() == [1]
    # A failure after the data was written and before its publication, and a repetition:
    publish = table._publish
    table._publish = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table.append(spark.range(3, 4), "late")
    table._publish = publish
    assert ids(table.read()) == [0, 1, 2]
    table.append(spark.range(3, 4), "late")
    assert ids(table.read()) == [0, 1, 2, 3]
    assert len(table.vacuum(keep=2)) == 2  # what the two failures left


def test_writers_exclude_each_other(spark, table):
    table.append(spark.range(1), "a")
    with pytest.raises(Conflict):
        table._publish(1, {"run": "b", "folders": [], "schema": {}})
    assert table.entry(1)["run"] == "a"


def test_sinks_are_repeatable(spark, tmp_path):
    path = f"file://{tmp_path}/articles"
    rows = spark.createDataFrame([("b",), ("a",), (None,)], "url string")
    first = sinks.append_once(spark, path, rows, "day1")
    assert sorted((r.id, r.url or "") for r in first.collect()) == [(1, ""), (2, "a"), (3, "b")]
    sinks.append_once(spark, path, rows, "day1")
    sinks.append_once(spark, path, rows.limit(1), "day2")
    assert ids(Published(spark, path).read()) == [1, 2, 3, 4]
    sinks.reload_once(spark, path, Published(spark, path).read().where("id = 2"), "day3")
    assert ids(Published(spark, path).read()) == [2]


@pytest.fixture
def known(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS known_urls")
    yield history.UrlHistory(spark, "known_urls", f"file://{tmp_path}/known", buckets=16), f"{tmp_path}/known"
    spark.sql("DROP TABLE IF EXISTS known_urls")


def urls(spark, *xs):
    return spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "url string, pos int")


def files(folder):
    import pathlib

    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(folder).rglob("*.parquet")}


def test_bucketed_history(spark, known):
    table, folder = known
    table.add(urls(spark, *[f"u{i}" for i in range(50)], None, "u1"), "2026-06-01")
    first = files(folder)
    table.add(urls(spark, "u3", "v1", "v2"), "2026-06-02")
    assert first.items() <= files(folder).items()  # the first day's files weren't touched
    table.add(urls(spark, "u3", "v1", "v2"), "2026-06-02")  # again
    assert table.keys.count() == 52
    batch = urls(spark, "u7", "v2", "w", None, "w")
    got = table.fresh(batch)
    assert sorted((r.url or "", r.pos) for r in got.collect()) == [("", 3), ("w", 2), ("w", 4)]
    want = state.fresh(batch, table.keys, table.keys.limit(0))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    plan = table.fresh(batch)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and re.findall(r"Exchange \w+\(\S+ (\d+)\)", plan) == ["16"]  # the batch is dealt into the buckets
    assert "Exchange" not in plan[plan.index("FileScan parquet") - 200 :]  # and the history lies still
    spark.sql("DROP TABLE known_urls")  # another session finds the table by its files
    again = history.UrlHistory(spark, "known_urls", f"file://{folder}", buckets=16)
    assert again.keys.count() == 52 and sorted(r.pos for r in again.fresh(batch).collect()) == [2, 3, 4]


def test_filter_over_known_urls(spark, tmp_path):
    day1, day2 = urls(spark, *[f"u{i}" for i in range(3000)], None), urls(spark, *[f"v{i}" for i in range(1000)])
    path = f"file://{tmp_path}/filter"
    for day, keys in (("1", day1), ("2", day2), ("2", day2)):
        history.store_day(history.filter_of(keys, "url", bits=16, hashes=3), path, day)
    stored = spark.read.parquet(path)
    assert stored.groupBy("day").count().where("count > 2").count() == 0  # 2**16 bits are two rows a day
    whole = history.merged(stored)
    rows = urls(spark, *[f"u{i}" for i in range(0, 3000, 7)], *[f"v{i}" for i in range(0, 1000, 7)], *[f"w{i}" for i in range(2000)], None)
    flagged = history.marked(rows, "url", whole, bits=16, hashes=3)
    hits = {r.url for r in flagged.where("maybe").collect()}
    assert {r.url for r in rows.collect() if r.url and r.url[0] in "uv"} <= hits and None not in hits
    false_share = sum(1 for u in hits if u.startswith("w")) / 2000
    assert false_share < 2 * (1 - 2.718281828 ** (-3 * 4000 / 2**16)) ** 3 + 0.005
    both = day1.select("url").union(day2.select("url"))
    got = history.fresh_by_filter(rows, "url", whole, both, bits=16, hashes=3)
    assert sorted(map(str, got.collect())) == sorted(map(str, state.fresh(rows, both, both.limit(0)).select(*got.columns).collect()))
    assert history.marked(rows, "url", whole.limit(0), bits=16, hashes=3).where("maybe").count() == 0
