"""Fetching of URLs: ``fetch_pages`` for a DataFrame of any number of them, and a Python data source for a short list, with one partition
per slice of the list; retries with back-off as the feeds need it.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("list", "\n".join(urls)).option("slices", 10).load()

Failed pages have a null body and the error. Only status 403 and 429 are tried again, and only if a proxy is set, from the second try on
through it.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls as url_functions

SCHEMA = "url string, status int, content_type string, body string, error string"
TIMEOUT, RETRIES, BACKOFF = 15.0, 2, 2.0


def fetch(url: str, proxy: str | None = None, opener=None, sleep=time.sleep) -> tuple:
    """(url, status, content type, body, error)."""
    for attempt in range(RETRIES + 1):
        try:
            through = {"http": proxy, "https": proxy} if proxy and attempt else {}
            get = opener or urllib.request.build_opener(urllib.request.ProxyHandler(through)).open
            with get(url, timeout=TIMEOUT) as r:
                return url, r.status, r.headers.get("Content-Type"), r.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            if e.code in (403, 429) and proxy and attempt < RETRIES:
                sleep(BACKOFF * 2**attempt)
                continue
            return url, e.code, None, None, str(e)
        except Exception as e:  # any failure of the network is this page's alone
            return url, None, None, None, str(e)


def fetch_pages(pages: DataFrame, slices: int = 8, proxy: str | None = None, opener=None) -> DataFrame:
    """``pages`` (url) fetched in ``slices`` tasks: SCHEMA, a row per distinct URL. Hosts that aren't fetched are left out before."""
    import pandas as pd

    wanted = pages.where(~url_functions.skip_domain(F.col("url"))).select("url").distinct().repartition(slices, "url")

    def run(batches):
        for b in batches:
            yield pd.DataFrame([fetch(u, proxy, opener) for u in b.url], columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"status": "Int32"})

    return wanted.mapInPandas(run, SCHEMA)


def html_of(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """url, html for each URL of ``pages``: the body of what was fetched well and is HTML, else the empty string (hosts that aren't
    fetched, failures, other content)."""
    ok = F.col("status").between(200, 299) & F.contains("content_type", F.lit("text/html")) & ~url_functions.skip_domain(F.col("url"))
    good = fetched.where(ok).groupBy("url").agg(F.max("body").alias("html"))
    return pages.select("url").distinct().join(good, "url", "left").select("url", F.coalesce("html", F.lit("")).alias("html"))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("list", "").split("\n") if u]
        self.slices, self.proxy = int(options.get("slices", 8)), options.get("proxy")

    def partitions(self):
        return [InputPartition(i) for i in range(min(self.slices, max(1, len(self.urls))))]

    def read(self, partition):
        n = min(self.slices, max(1, len(self.urls)))
        for u in self.urls[partition.value :: n]:
            yield fetch(u, self.proxy)


class PageSource(DataSource):
    @classmethod
    def name(cls):
        return "pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
