"""Numbered manifests: small JSON files that say which folders of a table count. A table changes in one step when its next manifest gets
its name; readers see the state before or after, and what a failed job left behind is named by none."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Manifests:
    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self.folder = path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Of all manifests, in order."""
        where = self._path(self.folder)
        if not self._fs.exists(where):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit())

    def newest(self, below: int | None = None) -> tuple[int, dict[str, Any]]:
        """The highest number, below another if one is given, and its content; -1 and nothing if there is none."""
        known = [n for n in self.numbers() if below is None or n < below]
        if not known:
            return -1, {}
        stream = self._fs.open(self._path(f"{self.folder}/{known[-1]}"))
        try:
            return known[-1], json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, content: dict[str, Any]) -> None:
        """Writes aside, then gives the name. A number that exists is replaced: the same batch has run again."""
        final, aside = self._path(f"{self.folder}/{number}"), self._path(f"{self.folder}/.{number}.new")
        out = self._fs.create(aside, True)
        out.write(json.dumps(content).encode())
        out.close()
        if self._fs.exists(final):
            self._fs.delete(final, False)
        if not self._fs.rename(aside, final):
            raise OSError(f"{final} can't be named")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def children(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []
