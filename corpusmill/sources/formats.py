"""Formats for ``spark.read.format``: registered once a session, then used by name.

``register(spark)`` makes ``corpusmill_zip`` known, which reads the members of
zip archives below a folder that driver and executors share: a partition for
each ``members`` members of an archive, so large archives are read side by side.
"""

from __future__ import annotations

import glob
import os
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Members(InputPartition):
    def __init__(self, archive: str, names: list[str]):
        super().__init__((archive, tuple(names)))
        self.archive, self.names = archive, names


class _Reader(DataSourceReader):
    def __init__(self, path: str, members: int, suffixes: tuple[str, ...]):
        self.path, self.members, self.suffixes = path, members, suffixes

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "**", "*.zip"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        out: list[InputPartition] = []
        for archive in found:
            with zipfile.ZipFile(archive) as z:
                names = [n for n in z.namelist() if not n.endswith("/") and n.lower().endswith(self.suffixes)]
            out += [Members(archive, names[i : i + self.members]) for i in range(0, len(names), self.members)]
        return out

    def read(self, partition):
        if partition is None:  # no member at all
            return
        with zipfile.ZipFile(partition.archive) as z:
            for n in partition.names:
                yield partition.archive, n, z.read(n)


class ZipSource(DataSource):
    """Options: ``members`` (of a partition, 1000 unless given) and ``suffixes`` (separated by commas; all members unless given)."""

    @classmethod
    def name(cls) -> str:
        return "corpusmill_zip"

    def schema(self) -> str:
        return "archive string, name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        return _Reader(path, int(self.options.get("members", "1000")), tuple(s.strip().lower() for s in self.options.get("suffixes", "").split(",")))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    spark.dataSource.register(ZipSource)
