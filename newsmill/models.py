"""The model functions of the daily run as typed batch functions, and rule-based stand-ins that SQL can express.

A model implements methods that take and return a pandas frame. ``apply`` runs one over a DataFrame in fixed chunks; failures become
an ``error`` text, so that the caller decides per step: scoring stops, dedup passes through, the rest goes row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    def score(self, rows: pd.DataFrame) -> pd.DataFrame:  # url, title, source, snippet, trust -> url, score
        ...

    def improve_titles(self, rows: pd.DataFrame) -> pd.DataFrame:  # url, title, source -> url, title
        ...

    def summarize(self, rows: pd.DataFrame) -> pd.DataFrame:  # id, title, content -> id, summary, categories, kind
        ...

    def categorize(self, rows: pd.DataFrame) -> pd.DataFrame:  # id, title -> id, categories
        ...

    def classify_kind(self, rows: pd.DataFrame) -> pd.DataFrame:  # id, title, url, summary -> id, kind
        ...

    def embed(self, rows: pd.DataFrame) -> pd.DataFrame:  # id, text -> id, embedding
        ...

    def same_story(self, rows: pd.DataFrame) -> pd.DataFrame:  # url, title, known_url, known_title -> url, known_url of equal stories
        ...

    def classify_profiles(self, rows: pd.DataFrame) -> pd.DataFrame:  # handle, name, description -> handle, related, confidence
        ...

    def extract_links(self, rows: pd.DataFrame) -> pd.DataFrame:  # id, html -> id, links (url, text)
        ...

    def extract_products(self, rows: pd.DataFrame) -> pd.DataFrame:  # id, text -> id, products (name, description)
        ...

    def select_products(self, rows: pd.DataFrame) -> pd.DataFrame:  # id, products -> id, numbers (from 1)
        ...

    def select_link(self, rows: pd.DataFrame) -> pd.DataFrame:  # id, name, description, candidates -> id, number (from 1; 0: none), confidence
        ...


def apply(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk: int = 5, on_error: str = "raise") -> DataFrame:
    """``call`` on chunks of ``chunk`` rows. on_error: "raise"; or "keep", which gives the chunk's rows an ``error`` and nulls elsewhere
    (``schema`` must then hold the key columns it shares with ``df``, and an ``error string`` is added)."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    if on_error == "keep":
        schema += ", error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), chunk):
                part = b.iloc[i : i + chunk]
                try:
                    out = call(part)[names]
                    yield out.assign(error=None) if on_error == "keep" else out
                except Exception as e:  # a model's failure of any kind is the step's to judge
                    if on_error != "keep":
                        raise
                    yield pd.DataFrame({c: part[c] if c in part else None for c in names} | {"error": str(e)}, index=part.index)

    return df.mapInPandas(run, schema)


def rule_score(title: Column, content: Column) -> Column:
    """Stand-in score: longer texts with a title of several words score higher."""
    return F.least(F.lit(100), (F.length(content) / 20).cast("int") + F.size(F.split(title, " ")) * 2)


def rule_kind(content: Column) -> Column:
    return F.when(content.contains("|"), "product").when(F.length(content) < 400, "announcement").otherwise("blog")


def rule_categories(content: Column) -> Column:
    return F.filter(
        F.array(F.when(F.length(content) % 2 == 0, "models"), F.when(F.length(content) % 3 == 0, "dev"), F.when(F.length(content) % 5 == 0, "research")), lambda x: x.isNotNull()
    )


def rule_summary(content: Column) -> Column:
    return F.substring(content, 1, 120)


def hashed_embedding(rows: pd.DataFrame, size: int = 256) -> pd.DataFrame:
    """Stand-in embedder: signed word hashing, unit length."""
    import zlib

    import numpy as np

    out = []
    for t in rows.text:
        v = np.zeros(size)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1 if h >> 31 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return pd.DataFrame({"id": rows.id, "embedding": out})
