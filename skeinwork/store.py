"""Many tables as one state: versioned folders, and one pointer that says which version counts.

A commit writes its tables to a folder of its own and then the pointer, a small file that names the folder of every table. Readers hold the pointer they
opened, so a commit that breaks off, or a later one, changes nothing for them. Tables that a commit does not touch stay where they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit has come between."""


class Store:
    """A store in the folder root, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the committed versions, in order."""
        path, fs = self._fs()
        top = path(f"{self.root}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n) for n in names if n.isdigit())

    def places(self, version: int | None = None) -> dict[str, str]:
        """Where each table of a version is, of the last by default; nothing before the first commit."""
        known = self.versions()
        if not known:
            return {}
        text = self.spark.read.text(f"{self.root}/versions/{known[-1] if version is None else version:010d}", wholetext=True).first()[0]
        return {name: f"{self.root}/{place}" for name, place in json.loads(text).items()}

    def read(self, version: int | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables of a version; later commits do not change what they hold."""
        return {n: self.spark.read.parquet(p) for n, p in self.places(version).items() if names is None or n in names}

    def commit(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = (), base: int | None = None) -> int:
        """Writes the tables and makes them and all others of the last version the new one, without those to drop; gives its number.

        base is the version the tables were made from: if it is no longer the last one, Conflict is raised and nothing changes.
        """
        known = self.versions()
        last = known[-1] if known else 0
        if base is not None and base != last:
            raise Conflict(f"version {base} is not the last one, {last}")
        folder = f"data/{last + 1:010d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        places = {n: p.removeprefix(f"{self.root}/") for n, p in self.places().items() if n not in drop}
        self._point(last + 1, places | {n: f"{folder}/{n}" for n in tables})
        return last + 1

    def _point(self, version: int, places: dict[str, str]) -> None:
        """Puts the pointer in place, whole or not at all, and only if there is none of that number."""
        path, fs = self._fs()
        fs.mkdirs(path(f"{self.root}/versions"))
        made, final = path(f"{self.root}/versions/.{uuid.uuid4().hex}"), path(f"{self.root}/versions/{version:010d}")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(places, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(made, final):
            fs.delete(made, False)
            raise Conflict(f"version {version} is there already")

    def vacuum(self, keep: int = 2) -> int:
        """Removes versions but the last ones, and all folders that no version left names, those of broken commits too; gives the number of folders. No commit may run meanwhile."""
        path, fs = self._fs()
        known = self.versions()
        needed = {p.removeprefix(f"{self.root}/").split("/")[1] for v in known[-keep:] for p in self.places(v).values()}
        for v in known[:-keep]:
            fs.delete(path(f"{self.root}/versions/{v:010d}"), False)
        top, gone = path(f"{self.root}/data"), 0
        for x in fs.listStatus(top) if fs.exists(top) else []:
            if x.getPath().getName() not in needed:
                fs.delete(x.getPath(), True)
                gone += 1
        return gone
