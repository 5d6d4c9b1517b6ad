"""Opening files of the shared folder from tasks, by URI (file, hdfs, s3, gs: whatever pyarrow's file systems know)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A stream whose file appears under its name only when complete, so a repeated or speculative task leaves one whole file."""
    system, path = at(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


def reading(uri: str):
    """A seekable stream."""
    system, path = at(uri)
    return system.open_input_file(path)


def delete_folder(spark, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
