"""Snapshots of facts in Parquet: a folder per version, made public by one commit file.

A writer fills a folder of its own and then links its name as the next version's commit file, which
the file system refuses if that version is there already: of two writers one wins, and no folder
is ever shared.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..schema import FACTS, conform


class SnapshotStore:
    """Versions of all fact tables below ``root``.

    A version counts once its commit file is there, so readers never see half of one.
    ``symbols``, ``refs`` and ``calls`` are sorted by their lookup keys within files, so Parquet's
    row-group statistics prune point lookups.
    """

    SORTED = {"symbols": "symbol_id", "refs": "symbol_id", "calls": "to_id", "type_edges": "parent_id", "words": "name"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        _, fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def _commit(self, version: int, folder: str) -> bool:
        """Link ``folder`` as ``version``; false if another writer has that version."""
        jvm, fs, path = self._fs()
        fs.mkdirs(path)
        draft = jvm.org.apache.hadoop.fs.Path(path, f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(folder.encode())
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(path, str(version))
        try:
            if fs.getUri().getScheme() == "file":  # a rename replaces files there, a link doesn't
                at = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI.create(f"file://{p.toUri().getPath()}"))
                jvm.java.nio.file.Files.createLink(at(final), at(draft))
                fs.delete(draft, False)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(draft, final, plain)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False
        return True

    def write(self, facts: dict[str, DataFrame], after: int | None = None) -> int:
        """A new version with these facts.  With ``after``, only if that is still the newest one."""
        newest = (self.versions() or [0])[-1]
        if after is not None and after != newest:
            self.check_current(after)
        version, folder = newest + 1, f"data-{uuid.uuid4().hex}"

        def save(name: str) -> None:
            rows = conform(name, facts[name])
            if name in self.SORTED:
                rows = rows.repartitionByRange(F.col(self.SORTED[name])).sortWithinPartitions(self.SORTED[name])
            rows.write.parquet(f"{self.root}/{folder}/{name}")

        with ThreadPoolExecutor(4) as pool:  # the tables don't depend on each other
            list(pool.map(save, facts))
        while not self._commit(version, folder):
            if after is not None:
                raise QueryError("workspace_changed", f"another writer made snapshot {version}", expected=str(after), actual=str(version))
            version += 1
        return version

    def _folder(self, version: int) -> str:
        return f"{self.root}/{self.spark.read.text(f'{self.root}/commits/{version}').first()[0]}"

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        known = self.versions()
        if not known:
            raise QueryError("solution_not_selected", "no snapshot has been written")
        version = known[-1] if version is None else version
        if version not in known:
            raise QueryError("stale_workspace_snapshot", f"there is no snapshot {version}")
        folder, tables = self._folder(version), {}
        for name, schema in FACTS.items():
            try:
                tables[name] = self.spark.read.schema(schema).parquet(f"{folder}/{name}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                tables[name] = self.spark.createDataFrame([], schema)
        return tables

    def check_current(self, version: int) -> None:
        """An optimistic check before a write: another snapshot means that ids are stale."""
        latest = (self.versions() or [0])[-1]
        if version != latest:
            raise QueryError("workspace_changed", f"the snapshot is {latest}, not {version}", expected=str(version), actual=str(latest))
