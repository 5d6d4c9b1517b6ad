"""Admission of URLs by state: what a stream has admitted is remembered in Spark's state store and forgotten after a while.

Unlike :mod:`admission`, which looks into its target for every micro-batch, nothing is read but the batch and the state of its URLs. The
table of URLs known before is the state's start. State is kept in RocksDB, on the executors' disks and in the checkpoint, so its size isn't
bounded by memory, and a restart goes on where the last run was.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOURS = 168
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """For each URL the time it was admitted. Of a batch's rows of a URL the first by ``order`` is admitted if the URL is unknown or was admitted
    ``hours`` before or earlier; timers only clear the state of what doesn't come again."""

    def __init__(self, columns: list[str], at: str, order: str, hours: int):
        self.columns, self.at, self.order, self.life = columns, at, order, timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "at timestamp")

    def _admitted(self) -> pd.Timestamp:
        at = pd.Timestamp(self.seen.get()[0])
        return at.tz_localize("UTC") if at.tzinfo is None else at

    def _remember(self, at: pd.Timestamp) -> None:
        self.seen.update((at.to_pydatetime(),))
        self.handle.registerTimer(int((at + self.life).timestamp() * 1000))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._remember(pd.Timestamp(initialState[self.at].min()).tz_localize("UTC"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:  # a URL's rows come in pieces; one row is held
            best = part.sort_values(self.order, kind="stable").head(1)
            first = best if first is None or best[self.order].iloc[0] < first[self.order].iloc[0] else first
        if first is None:
            return
        at = pd.Timestamp(first[self.at].iloc[0]).tz_localize("UTC")
        if not self.seen.exists() or at - self._admitted() >= self.life:
            self._remember(at)
            yield first[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and (self._admitted() + self.life).timestamp() * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def in_window(rows: DataFrame, published: str, at: str, hours: int = HOURS) -> DataFrame:
    """Rows published at most ``hours`` before they came, and undated ones."""
    return rows.where(F.col(published).isNull() | (F.col(published) >= F.col(at) - F.make_dt_interval(hours=F.lit(hours))))


def admitted(stream: DataFrame, known: DataFrame | None = None, key: str = "url", at: str = "seen_at", order: str = "pos", published: str | None = None, hours: int = HOURS, late: str = "1 hour") -> DataFrame:
    """Rows of ``stream`` whose ``key`` wasn't admitted in the ``hours`` before, the first by ``order`` of each batch; rows with a null key all.

    ``at`` (not null) says when a row came and is the stream's event time: a key's state is cleared when the watermark, ``late`` behind the latest
    row, has passed its time by ``hours``, and rows older than the watermark of the batch before are dropped. ``known`` (key, at) are keys admitted before
    the stream's first start; they are read by it alone. With ``published``, rows dated more than ``hours`` before they came are refused and
    undated ones kept."""
    rows = in_window(stream, published, at, hours) if published else stream
    rows = rows.withWatermark(at, late)
    processor = Admission(rows.columns, at, order, hours)
    start = known.where(F.col(key).isNotNull()).select(key, at).groupBy(key) if known is not None else None
    keyed = rows.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(processor, rows.schema, "Append", "EventTime", start)
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def admit_by_state(stream: DataFrame, target: str, checkpoint: str, **options):
    """:func:`admitted` rows appended to the table at ``target``, each once whatever fails on the way: the file sink's own log and the checkpoint
    say what is done. Runs what is available and stops."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = admitted(stream, **options)
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
