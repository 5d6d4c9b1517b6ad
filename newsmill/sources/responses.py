"""Pages of a listing as responses, {"data": [...], "count": n}, written by a data source: one file for each request and part, all or none.

Tasks write drafts and report them; the commit moves them in place under the request's name, and an abort deletes them. A request that is
there already isn't written again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def response(page: DataFrame, total: DataFrame, order: str) -> DataFrame:
    """One row (data, count): the rows of ``page`` as JSON objects in ``order`` (a page is bounded by its limit) and the number in ``total`` (count)."""
    one = F.struct(F.col(order).alias("o"), F.to_json(F.struct(*page.columns)).alias("j"))
    data = page.agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["j"]).alias("data"))
    return data.crossJoin(total.select(F.col("count").cast("long")))


@dataclass
class Drafts(WriterCommitMessage):
    files: list


class ResponseSink(DataSource):
    """Format "responses" with options path and request; takes rows (data array<string>, count long)."""

    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return "data array<string>, count long"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["request"], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, request: str, overwrite: bool):
        self.path, self.request, self.overwrite = path, request, overwrite

    def _store(self):
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator) -> Drafts:
        system, root = self._store()
        files = []
        for batch in iterator:
            for data, count in zip(batch.column("data").to_pylist(), batch.column("count").to_pylist()):
                system.create_dir(f"{root}/_drafts", recursive=True)
                draft = f"{root}/_drafts/{self.request}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(('{"data":[' + ",".join(data or []) + f'],"count":{json.dumps(count)}}}').encode())
                files.append(draft)
        return Drafts(files)

    def _files(self, messages) -> list:
        return sorted(f for m in messages if m is not None for f in m.files)

    def commit(self, messages) -> None:
        system, root = self._store()
        done = f"{root}/{self.request}"
        there = system.get_file_info(done).type != fs.FileType.NotFound
        if there and not self.overwrite:
            return self.abort(messages)
        staged = f"{root}/_drafts/{self.request}.{uuid.uuid4().hex}"
        system.create_dir(staged, recursive=True)
        for i, f in enumerate(self._files(messages)):
            system.move(f, f"{staged}/{i:05d}.json")
        if there:
            system.delete_dir(done)
        system.move(staged, done)

    def abort(self, messages) -> None:
        system, _ = self._store()
        for f in self._files(messages):
            if system.get_file_info(f).type != fs.FileType.NotFound:
                system.delete_file(f)
