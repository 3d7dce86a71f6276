"""Tables kept as numbered versions: staged, committed only on the version they were made from, and restored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """A folder of versions 1, 2, ... of one table; each is written aside and then renamed into its place.

    The rename is the commit: of two writers that start from one version, one gets the next number
    and the other's commit is refused. Readers of a version aren't disturbed by later ones.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, version: int) -> str:
        return f"{self.root}/version={version:08d}"

    def all(self) -> list[int]:
        if not self._files.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.root))]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def current(self) -> int:
        """The newest version's number, 0 before the first."""
        return max(self.all(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._place(self.current() if version is None else version))

    def commit(self, table: DataFrame, expected: int) -> bool:
        """Make `table` the next version if `expected` is still the newest; else nothing changes and the result is False.

        Whatever fails before the rename leaves the versions as they were and nothing staged.
        """
        if self.current() != expected:
            return False
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
        try:
            table.write.parquet(staged)
            place = self._path(self._place(expected + 1))
            return not self._files.exists(place) and bool(self._files.rename(self._path(staged), place))
        finally:
            self._files.delete(self._path(staged), True)

    def restore(self, version: int, expected: int) -> bool:
        """Make an earlier version's rows the next version."""
        return self.commit(self.read(version), expected)
