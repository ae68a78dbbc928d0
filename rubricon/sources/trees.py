"""A data source of whole files under a folder tree, whatever their names hold.

Spark's file sources take a colon in a folder's name for a scheme and fail. This one lists the tree
itself and reads a bounded number of files per partition. The tree is on a path that the driver and
all executors have mounted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = 64


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.name = options.get("name")
        self.files = int(options.get("files", FILES))

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise ValueError(f"no folder {self.root}")
        found = [os.path.join(folder, f) for folder, _, files in os.walk(self.root) for f in files if self.name in (None, f)]
        found.sort()
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        for name in partition.names:
            with open(name, encoding="utf-8") as file:
                yield os.path.relpath(name, self.root), file.read()


class FolderTree(DataSource):
    """``spark.read.format("folder_tree").load(folder)``: path under the folder, and value, the text.

    Options: ``name`` takes files of that name only, ``files`` bounds the files of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
