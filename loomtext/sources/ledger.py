"""A commit log: numbered files, each created only if it is absent.

A version is one JSON document. A writer reads the latest version, does its
work in new files, and then tries to create the next number; if another writer
was first it looks at what changed and tries again. So of two writers that race
neither overwrites the other, and readers see whole versions only.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Other writers were first too many times."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/_log"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """The number and content of a version, the latest by default; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, {}
        p, fs = self._fs(f"{self.path}/{version:012d}.json")
        stream = fs.open(p)
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, version: int, content: dict) -> bool:
        """Whether this version was ours to make. It appears whole or not at all."""
        target, fs = self._fs(f"{self.path}/{version:012d}.json")
        temp, _ = self._fs(f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a local rename would replace what is there; a link won't
                files, paths = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.nio.file.Paths
                try:
                    files.createLink(paths.get(target.toUri().getPath(), self._none()), paths.get(temp.toUri().getPath(), self._none()))
                    return True
                except Exception as e:
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
            return not fs.exists(target) and fs.rename(temp, target)
        finally:
            fs.delete(temp, False)

    def _none(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)

    def commit(self, change: Callable[[int, dict], dict | None], tries: int = 30) -> int:
        """Make the next version from ``change(version, content)`` of the latest one, again for each version that others put in between.

        ``change`` gives the new content, or None if nothing is to be written.
        """
        for n in range(tries):
            version, content = self.read()
            made = change(version, content)
            if made is None:
                return version
            if self.create(version + 1, made):
                return version + 1
            time.sleep(random.uniform(0, 0.05 * min(n + 1, 10)))
        raise Conflict(f"{self.path}: no version after {tries} tries")
