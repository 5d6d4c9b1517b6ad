"""Tables whose versions are published: data is written beside the old version, and one rename makes it the current one.

    path/data/<folder>/...      data files, never changed once written
    path/_versions/00000012     a version: its run and the data folders that it is made of

A reader takes the newest version, so it sees all of a run or nothing. A run has a name: publishing under a name that is already there does nothing, so a
failed run can be repeated, whether it failed before or after its publication. Two writers of one version exclude each other where the
file system's rename refuses an existing target (HDFS, local disks); object stores need one writer a table. Old versions stay readable until
:meth:`Published.vacuum` deletes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has published the version first."""


class Published:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda p: hadoop.Path(f"{self.path}/{p}")
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions

    def versions(self) -> list[int]:
        at = self._at("_versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def entry(self, version: int) -> dict:
        """{"run", "folders", "schema"} of a version."""
        stream = self._fs.open(self._at(f"_versions/{version:08d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version_of(self, run: str) -> int | None:
        """The version that ``run`` published. Newer ones are looked at first."""
        return next((v for v in reversed(self.versions()) if self.entry(v)["run"] == run), None)

    def _publish(self, version: int, entry: dict) -> None:
        draft = self._at(f"_versions/_{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        target = self._at(f"_versions/{version:08d}")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} was published by another run")

    # --- reading

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an older one."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"{self.path} has no published version")
        entry = self.entry(known[-1] if version is None else version)
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(entry["schema"])
        if not entry["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in entry["folders"]])

    # --- writing

    def replace(self, rows: DataFrame, run: str | None = None) -> int:
        """``rows``, which may be read from this table, become its contents. Returns the version."""
        return self._write(rows, run, keep=False)

    def append(self, rows: DataFrame, run: str | None = None) -> int:
        """``rows`` are added; what is there isn't written again. New columns come as nulls of old rows."""
        return self._write(rows, run, keep=True)

    def _write(self, rows: DataFrame, run: str | None, keep: bool) -> int:
        run = run or uuid.uuid4().hex
        done = self.version_of(run)
        if done is not None:
            return done
        known = self.versions()
        last = self.entry(known[-1]) if known else None
        folder = f"{run}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/data/{folder}")
        schema = json.loads(rows.schema.json())
        folders = [folder]
        if keep and last:
            names = {f["name"]: f for f in last["schema"]["fields"]}
            for f in schema["fields"]:
                if f["name"] in names and names[f["name"]]["type"] != f["type"]:
                    raise ValueError(f"column {f['name']} of the appended rows has another type")
                names.setdefault(f["name"], f | {"nullable": True})
            schema, folders = {"type": "struct", "fields": list(names.values())}, [*last["folders"], folder]
        version = (known[-1] if known else 0) + 1
        self._publish(version, {"run": run, "folders": folders, "schema": schema})
        return version

    # --- upkeep

    def compact(self, run: str | None = None) -> int:
        """The current contents in one folder."""
        return self.replace(self.read(), run or f"compact-{uuid.uuid4().hex[:8]}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete versions but the last ``keep``, and the data that none of these holds: also what failed runs left, so no run may be writing."""
        known = self.versions()
        held = {f for v in known[-keep:] for f in self.entry(v)["folders"]}
        for v in known[:-keep]:
            self._fs.delete(self._at(f"_versions/{v:08d}"), False)
        gone = []
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                name = s.getPath().getName()
                if name not in held:
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        return sorted(gone)
