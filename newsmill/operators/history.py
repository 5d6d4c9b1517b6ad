"""Known URLs as a table that needs no shuffle to be asked, and a filter of fixed size that spares most rows the asking.

The history is partitioned by day and bucketed by URL: a batch is dealt into the same buckets and joined with them where they lie. A day's batch
writes its own partition, under which a repeated run replaces what it left; other days' files stay as they are. The filter is a
Bloom filter kept as rows of 32,768 bits a day; days are merged by a bitwise or, and its size is a parameter, whatever the number of URLs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = 32_768


class UrlHistory:
    """A bucketed table of known keys at ``location``. ``buckets`` should be no fewer than the session's shuffle partitions: of fewer, Spark deals
    both sides anew."""

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int = 1024):
        self.spark, self.name = spark, name
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (url STRING, day DATE) USING parquet PARTITIONED BY (day) CLUSTERED BY (url) SORTED BY (url) INTO {int(buckets)} BUCKETS LOCATION '{location}'"
        )
        self.spark.sql(f"MSCK REPAIR TABLE {name}")  # a new session finds the days that are there

    @property
    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, day: str) -> None:
        """The keys of ``rows`` that earlier days don't hold become the partition of ``day``; a repeated run replaces it. Null keys are left out."""
        new = rows.select("url").where("url is not null").distinct()
        new = new.join(self.keys.where(F.col("day") < F.lit(day).cast("date")).select("url"), "url", "left_anti").withColumn("day", F.lit(day).cast("date"))
        old = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            new.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)

    def fresh(self, rows: DataFrame) -> DataFrame:
        """Rows whose URL isn't known; null URLs stay. Only ``rows`` is dealt by URL."""
        return rows.join(self.keys.select("url"), "url", "left_anti")


# --- the filter ------------------------------------------------------------------------------------


def _places(key: Column, bits: int, hashes: int) -> Column:
    """The bits that a key sets."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1 << bits)) for i in range(hashes)])


def filter_of(keys: DataFrame, key: str, bits: int = 27, hashes: int = 4) -> DataFrame:
    """(part, bits): the filter of the not-null keys, 2**bits bits in rows of 32,768; made of partial bitmaps in the tasks."""
    at = keys.where(F.col(key).isNotNull()).select(F.explode(_places(F.col(key), bits, hashes)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / ROW).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % ROW).alias("bits"))


def merged(filters: DataFrame) -> DataFrame:
    """One filter of many (part, bits) with equal parameters."""
    return filters.groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))


def store_day(filter_: DataFrame, path: str, day: str) -> None:
    """A day's filter in the table at ``path``; a repeated run replaces it."""
    filter_.withColumn("day", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def marked(rows: DataFrame, key: str, filter_: DataFrame, bits: int = 27, hashes: int = 4, column: str = "maybe") -> DataFrame:
    """``rows`` with a flag: false if the filter's keys don't hold the row's for sure. A null key is in none.

    The filter is sent to all tasks, 2**bits / 8 bytes (16 MB with the default), and each of a key's bits is looked up there."""
    out, places, flags = rows, _places(F.col(key), bits, hashes), []
    for i in range(hashes):
        at = places[i]
        row = F.broadcast(filter_.select(F.col("part").alias(f"_part{i}"), F.col("bits").alias(f"_bits{i}")))
        out = out.join(row, F.floor(at / ROW).cast("int") == F.col(f"_part{i}"), "left")
        byte = F.conv(F.hex(F.substr(f"_bits{i}", (F.floor(at % ROW / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        flags.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    return out.withColumn(column, F.col(key).isNotNull() & reduce(lambda a, b: a & b, flags)).select(*[rows[c] for c in rows.columns], column)


def fresh_by_filter(rows: DataFrame, key: str, filter_: DataFrame, history: DataFrame, bits: int = 27, hashes: int = 4) -> DataFrame:
    """Rows whose key isn't in ``history``, exactly: only those that the filter doesn't clear are joined. ``filter_`` must hold all of its keys."""
    flagged = marked(rows, key, filter_, bits, hashes, "_maybe")
    sure = flagged.where(~F.col("_maybe")).drop("_maybe")
    return sure.unionByName(flagged.where("_maybe").drop("_maybe").join(history.select(key), key, "left_anti").select(*rows.columns))
