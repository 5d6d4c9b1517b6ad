"""Model calls that survive failures: answers are written to a ledger as they come, and a rerun asks only for what isn't there.

    path/<step>/part-<hash>.parquet      (key, answer columns): a few chunks' answers, written by the task that got them

A row's key is a hash of the step and of the columns that the model is given, so equal content is asked once, in one run and in all. Tasks write their
own files, under names that depend on the keys alone: a task that is tried again or twice leaves one file. A failed call is repeated after
growing pauses; calls of a task follow each other with a pause, which, times the number of tasks at work, bounds the rate.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from . import models

#: Models that this worker has loaded, by name.
_LOADED: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The model ``name``, loaded once in each Python worker."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def key_of(step: str, columns: list[str]):
    """A hash of the step and the content; a null differs from every text."""
    return F.sha2(F.to_json(F.struct(F.lit(step).alias("step"), *[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)


def tried(call: Callable, part: pd.DataFrame, attempts: int, backoff: float, sleep=time.sleep):
    """``call(part)``, repeated up to ``attempts`` times with pauses of backoff, 2 * backoff, ... seconds; the last failure is raised."""
    for i in range(attempts):
        try:
            return call(part)
        except Exception:
            if i + 1 == attempts:
                raise
            sleep(backoff * 2**i)


def _write(uri: str, table: pa.Table, name: str) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        pq.write_table(table, out)
    system.move(draft, f"{path}/part-{name}.parquet")


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def answers(self, step: str, schema: str | StructType) -> DataFrame:
        """(key, answer columns) of a step, each key once."""
        kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
        whole = StructType(_parse_datatype_string("key string").fields + kind.fields)
        try:
            rows = self.spark.read.schema(whole).parquet(f"{self.path}/{step}")
        except Exception as e:  # the first run finds none
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], whole)
        return rows.dropDuplicates(["key"])

    def ask(
        self, rows: DataFrame, step: str, given: list[str], call: Callable | None, schema: str, chunk: int = 5, attempts: int = 3, backoff: float = 2.0, pause: float = 0.0,
        load: Callable[[], Callable] | None = None, tasks: int | None = None, flush: int = 1, on_error: str = "raise", hashed: list[str] | None = None,
    ) -> DataFrame:
        """``rows`` with the model's answers. ``call`` takes a pandas frame of ``given`` in chunks of ``chunk`` rows and returns a frame of ``schema``
        in the same order; ``load`` returns such a function, once in each worker. ``pause`` seconds lie between calls of a task, and ``tasks``
        tasks call at a time. Every ``flush`` chunks are written. on_error "keep" gives rows of failed chunks nulls and leaves them for the next run. ``hashed`` names the columns that
        make content equal, if these aren't all that are given."""
        step_name, kind = step, _parse_datatype_string(schema)
        keyed = rows.withColumn("_key", key_of(step, hashed or given))
        asked = keyed.select(F.col("_key").alias("key"), *[F.col(f"`{c}`") for c in given]).dropDuplicates(["key"])
        todo = asked.join(self.answers(step, kind).select("key"), "key", "left_anti")
        if tasks:
            todo = todo.repartition(tasks, "key")
        target, arrow = f"{self.path}/{step}", to_arrow_schema(StructType(_parse_datatype_string("key string").fields + kind.fields))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, held, first, done = loaded(step_name, load) if load else call, [], True, 0

            def write():
                if held:
                    whole = pd.concat(held, ignore_index=True)
                    name = xxhash.xxh3_128_hexdigest("".join(sorted(whole.key)))
                    _write(target, pa.Table.from_pandas(whole, arrow, preserve_index=False), name)
                    held.clear()

            for b in batches:
                for i in range(0, len(b), chunk):
                    part = b.iloc[i : i + chunk].reset_index(drop=True)
                    if not first and pause:
                        time.sleep(pause)
                    first = False
                    try:
                        out = tried(model, part[given], attempts, backoff)
                    except Exception:
                        if on_error != "keep":
                            write()
                            raise
                        continue
                    if len(out) != len(part):
                        raise ValueError(f"{step_name}: {len(out)} answers for {len(part)} rows")
                    held.append(out.reset_index(drop=True)[kind.names].assign(key=part.key)[["key", *kind.names]])
                    done += len(part)
                    if len(held) >= flush:
                        write()
            write()
            yield pd.DataFrame({"n": [done]})

        todo.mapInPandas(work, "n long").agg(F.sum("n")).collect()  # the calls are made here, once
        return keyed.join(self.answers(step, kind).withColumnRenamed("key", "_key"), "_key", "left").drop("_key")

    def compact(self, step: str, schema: str) -> None:
        """A step's many small files as few, while no run is writing."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        old, new = hadoop.Path(f"{self.path}/{step}"), hadoop.Path(f"{self.path}/_{step}.{uuid.uuid4().hex}")
        self.answers(step, schema).write.parquet(new.toString())
        system = old.getFileSystem(conf)
        before = [s.getPath() for s in system.listStatus(old)]
        for s in system.listStatus(new):  # the new files come first, so that a failure leaves answers twice and loses none
            if s.getPath().getName().endswith(".parquet"):
                system.rename(s.getPath(), hadoop.Path(old, s.getPath().getName()))
        for p in before:
            system.delete(p, False)
        system.delete(new, True)


def asked(rows: DataFrame, call: Callable, schema: str, chunk: int, on_error: str = "raise", book: Ledger | None = None, step: str = "", key: str = "url", **options) -> DataFrame:
    """``models.apply`` for functions whose answers carry the ``key`` that they are given, through a ledger if there is one: (key, answers), the last answer of
    a key, nulls where there is none. Options (attempts, backoff, pause, tasks, flush) are :meth:`Ledger.ask`'s."""
    if book is None:
        return models.apply(rows, call, schema, chunk, on_error)
    fields = [f for f in _parse_datatype_string(schema).fields if f.name != key]

    def aligned(part: pd.DataFrame) -> pd.DataFrame:
        out = call(part).drop_duplicates(key, keep="last").set_index(key).reindex(part[key])
        return pd.DataFrame({f"answer_{f.name}": [None if x is None or isinstance(x, float) and x != x else x for x in out[f.name]] for f in fields}, dtype=object)

    kind = ", ".join(f"answer_{f.name} {f.dataType.simpleString()}" for f in fields)
    got = book.ask(rows, step, rows.columns, aligned, kind, chunk=chunk, on_error=on_error, hashed=[c for c in rows.columns if c != "id"], **options)
    return got.select(key, *[F.col(f"answer_{f.name}").alias(f.name) for f in fields])


def embed(ledger: Ledger, texts: DataFrame, name: str, load: Callable[[], Callable], chunk: int = 64, **options) -> DataFrame:
    """(id, embedding) of (id, text): the model ``name`` is loaded once in each worker and sees each distinct text once in all runs; null texts have no
    embedding. ``load()`` returns a function of a frame with ``text`` that returns a frame with ``embedding``."""
    told = texts.where("text is not null").select("id", "text")
    found = ledger.ask(told, f"embed-{name}", ["text"], None, "embedding array<float>", chunk=chunk, load=load, **options)
    return texts.select("id").join(found.select("id", "embedding"), "id", "left")
