"""Stateful admission and event-time windows on streams of files, a file a batch."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsmill.operators import state
from newsmill.streaming import known, windows

SCHEMA = "url string, pos int, seen_at timestamp, published timestamp"
T0 = datetime(2026, 6, 1)


def hours(n):
    return T0 + timedelta(hours=n)


def give(spark, folder, rows, schema=SCHEMA):
    time.sleep(0.02)  # files are taken in order of their times
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def admitted(spark, tmp, **options):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    known.admit_by_state(s, f"{tmp}/out", f"{tmp}/cp", **options).awaitTermination()
    return sorted((r.url or "", r.pos) for r in spark.read.parquet(f"{tmp}/out").collect())


@pytest.fixture
def eight(spark):
    """RocksDB opens a store for each partition; few are enough here."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_admission_by_state(spark, tmp_path, eight):
    tmp = f"file://{tmp_path}"
    give(spark, f"{tmp}/in", [("a", 3, hours(0), hours(0)), ("a", 1, hours(0), None), ("b", 2, hours(0), hours(-10)), ("old", 9, hours(0), hours(-169)), (None, 4, hours(0), None), (None, 5, hours(0), None), ("k", 6, hours(0), None)])
    before = spark.createDataFrame([("k", hours(-1)), (None, hours(-1))], "url string, seen_at timestamp")
    first = [("", 4), ("", 5), ("a", 1), ("b", 2)]
    assert admitted(spark, tmp, known=before, published="published") == first
    give(spark, f"{tmp}/in", [("a", 7, hours(1), None), ("c", 8, hours(5), None), ("k", 9, hours(1), None)])
    assert admitted(spark, tmp, known=before, published="published") == first + [("c", 8)]  # a restart admits nothing twice
    assert admitted(spark, tmp, known=before, published="published") == first + [("c", 8)]
    give(spark, f"{tmp}/in", [("d", 10, hours(170), None)])  # more than 168 hours after a, b and k, not after c
    give(spark, f"{tmp}/in", [("a", 11, hours(169.5), None), ("c", 12, hours(169.5), None), ("k", 13, hours(169.5), None), ("a", 14, hours(169.6), None)])
    give(spark, f"{tmp}/in", [("x", 15, hours(100), None), ("a", 16, hours(172), None)])
    again = admitted(spark, tmp, known=before, published="published")
    assert sorted(set(again) - set(first)) == [("a", 11), ("c", 8), ("d", 10), ("k", 13)]  # x came later than the watermark of the batch before
    assert len(again) == len(set(again))


def test_one_batch_equals_the_batch_operator(spark, tmp_path, eight):
    tmp = f"file://{tmp_path}"
    rows = [(f"u{i * 7 % 40}", i, hours(i / 100), None) for i in range(200)]
    give(spark, f"{tmp}/in", rows)
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.createDataFrame([(f"u{i}", T0) for i in range(0, 40, 3)], "url string, seen_at timestamp")
    want = state.fresh(state.first_wins(df, "url", "pos"), old, old)
    assert admitted(spark, tmp, known=old) == sorted((r.url, r.pos) for r in want.collect())


EVENTS = "ts timestamp, k string, v int"


def minutes(n):
    return T0 + timedelta(minutes=n)


def test_windows_in_append_mode(spark, tmp_path, eight):
    tmp = f"file://{tmp_path}"

    def run():
        s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
        counts = windows.window_counts(s, "ts", "k", "10 minutes", late="5 minutes", value="v")
        windows.append_closed(counts, f"{tmp}/out", f"{tmp}/cp").awaitTermination()
        return sorted((r.window_start, r.k, r.n, r.total) for r in spark.read.parquet(f"{tmp}/out").collect())

    batches = [[(minutes(1), "a", 1), (minutes(9), "a", 2), (minutes(12), "b", 4)], [(minutes(8), "a", 8), (minutes(17), "a", 16)], [(minutes(2), "a", 32), (minutes(31), "b", 64)], [(minutes(90), "z", 128)]]
    for b in batches[:2]:
        give(spark, f"{tmp}/in", b, EVENTS)
    assert run() == [(minutes(0), "a", 3, 11)]  # minute 8 came late and is in, as the watermark stood at 7
    for b in batches[2:]:
        give(spark, f"{tmp}/in", b, EVENTS)
    got = run()  # minute 2 came after its window was closed
    kept = spark.createDataFrame([r for b in batches for r in b if r != (minutes(2), "a", 32)], EVENTS)
    want = windows.window_counts(kept, "ts", "k", "10 minutes", value="v").where(F.col("window_end") <= F.lit(minutes(85)))
    assert got == sorted((r.window_start, r.k, r.n, r.total) for r in want.collect()) and len(got) == 4


def test_sessions_in_append_mode(spark, tmp_path, eight):
    tmp = f"file://{tmp_path}"

    def run():
        s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
        windows.append_closed(windows.session_counts(s, "ts", "k", "10 minutes", "20 minutes"), f"{tmp}/out", f"{tmp}/cp").awaitTermination()
        return sorted((r.session_start, r.session_end, r.k, r.n) for r in spark.read.parquet(f"{tmp}/out").collect())

    batches = [[(minutes(0), "a", 1), (minutes(15), "a", 1), (minutes(3), "b", 1)], [(minutes(8), "a", 1), (minutes(40), "b", 1), (None, "a", 1)], [(minutes(41), "b", 1)], [(minutes(5), "b", 1), (minutes(200), "z", 1)], [(minutes(400), "z", 1)]]
    for b in batches:
        give(spark, f"{tmp}/in", b, EVENTS)
    got = run()
    # a's two sessions are merged by minute 8; b's minute 5 came after the watermark, at 20, had closed b's first session
    assert got == [(minutes(0), minutes(25), "a", 3), (minutes(3), minutes(13), "b", 1), (minutes(40), minutes(51), "b", 2), (minutes(200), minutes(210), "z", 1)]
    kept = spark.createDataFrame([r for b in batches[:4] for r in b if r != (minutes(5), "b", 1)], EVENTS)
    batch = windows.session_counts(kept, "ts", "k", "10 minutes")
    assert got == sorted((r.session_start, r.session_end, r.k, r.n) for r in batch.collect())
    assert run() == got  # nothing is written twice
