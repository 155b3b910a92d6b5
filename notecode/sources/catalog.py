"""One catalog of data sets by name, whose versions appear as a whole or not at all.

A version is written to a folder of its own; only then a small manifest names that folder. Readers take
the manifest with the highest number that is whole, so a write that dies half-way, or one that goes on
while others read, is never seen. Two publishers that finish together get different numbers.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_MANIFESTS = "_manifests"
MOST_TRIES = 100


class Outdated(RuntimeError):
    """Someone else has published a version in between."""


class Catalog:
    """The data sets below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, name: str, number: int):
        return self._path(name, _MANIFESTS, f"{number:012d}.json")

    def publish(
        self, rows: DataFrame, name: str, partitions: int | None = None, after: int | None = None
    ) -> int:
        """Write a new version of a data set and make it the current one; returns its number.

        With `after`, the version must follow that one, else `Outdated` is raised and nothing appears.
        """
        folder = f"data-{uuid.uuid4().hex}"
        rows = rows.repartition(partitions) if partitions else rows
        rows.write.parquet("/".join((self.root, name, folder)))
        entry = json.dumps({"folder": folder, "schema": rows.schema.jsonValue()})
        files, draft = self._files(), self._path(name, _MANIFESTS, f"_draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(entry.encode()))
        out.close()
        last = max(self.versions(name), default=0)
        tries = range(last + 1, last + 1 + MOST_TRIES) if after is None else [after + 1]
        for number in tries if after in (None, last) else []:
            target = self._manifest(name, number)
            if not files.exists(target) and files.rename(draft, target):
                return number
        if after is not None:
            files.delete(draft, False)
            raise Outdated(f"{name!r} has got a version after {after}")
        raise RuntimeError(f"no free version of {name!r} was found")

    def _entry(self, path) -> dict | None:
        """What a manifest holds; None if it is torn."""
        lines = self.spark.read.text(path.toString(), wholetext=True).collect()
        try:
            entry = json.loads(lines[0].value) if lines else None
        except json.JSONDecodeError:
            return None
        return entry if isinstance(entry, dict) and "folder" in entry else None

    def versions(self, name: str) -> list[int]:
        """The numbers of all manifests of a data set."""
        folder = self._path(name, _MANIFESTS)
        if not self._files().exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files().listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def folder(self, name: str, version: int | None = None) -> str:
        """Where a version lies; by default the last whole one."""
        for number in reversed(self.versions(name) if version is None else [version]):
            entry = self._entry(self._manifest(name, number))
            if entry:
                return "/".join((self.root, name, entry["folder"]))
        raise FileNotFoundError(f"the catalog {self.root} has no such version of {name!r}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(name, version))

    def names(self) -> list[str]:
        """The data sets that have a version."""
        statuses = self._files().listStatus(self._path()) if self._files().exists(self._path()) else []
        return sorted(n for n in (s.getPath().getName() for s in statuses) if self.versions(n))

    def clean(self, name: str, keep: int = 2) -> None:
        """Delete all but the last `keep` versions, and what dead writes have left.

        Call it when nothing is being published.
        """
        files, kept = self._files(), self.versions(name)[-keep:]
        for number in set(self.versions(name)) - set(kept):
            files.delete(self._manifest(name, number), False)
        used = {self.folder(name, number).rpartition("/")[2] for number in kept if self._entry(self._manifest(name, number))}
        for status in files.listStatus(self._path(name)):
            if status.getPath().getName() not in {*used, _MANIFESTS}:
                files.delete(status.getPath(), True)
        for status in files.listStatus(self._path(name, _MANIFESTS)):
            if status.getPath().getName().startswith("_draft-"):
                files.delete(status.getPath(), False)
