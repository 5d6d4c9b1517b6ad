"""Tables of a run: what stays and what goes."""

import pathlib

import pytest

from newsmill import shared


def tables(spark):
    where = pathlib.Path(shared.shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "newsmill"
    return {p.name for p in where.iterdir()} if where.exists() else set()


def test_one_table(spark):
    before = tables(spark)

    def make():
        a = shared.stored(spark.range(5), "first")
        with shared.scratch(spark, "inner"):
            n = shared.stored(a.where("id > 1"), "second").count()
        return shared.stored(a.where(f"id < {n}"), "third")

    out = shared.one_table(spark, "whole", make)
    assert sorted(r.id for r in out.collect()) == [0, 1, 2]
    assert len(tables(spark) - before) == 1 and next(iter(tables(spark) - before)).startswith("whole-result")
    assert shared.one_table(spark, "lazy", lambda: spark.range(3)).count() == 3 and len(tables(spark) - before) == 1


def test_failed_runs_leave_nothing(spark):
    before = tables(spark)

    def broken():
        shared.stored(spark.range(5), "first")
        raise ValueError("no")

    with pytest.raises(ValueError):
        shared.one_table(spark, "whole", broken)
    assert tables(spark) == before and not shared._OPEN
    shared.drop_stored(shared.stored(spark.range(2), "gone"))
    assert tables(spark) == before
