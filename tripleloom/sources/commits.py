"""A log of commits beside stored tables: numbered JSON files in one folder, each created once.

What a commit lists is what readers see, so a reader with a number sees one state whatever is written meanwhile.  Of two
writers that start from one state the second gets `Conflict`, and files that no commit lists are nobody's.  The folder's file system
must rename atomically, as HDFS does."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer committed first."""


@dataclass
class Log:
    spark: SparkSession
    path: str

    def _at(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        """Commits that are there, ascending."""
        fs, p = self._at()
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """A commit, the last one by default; ``(-1, {})`` if there is none."""
        if number is None:
            number = max(self.numbers(), default=-1)
            if number < 0:
                return -1, {}
        fs, p = self._at(f"{number:010d}.json")
        stream = fs.open(p)
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, after: int, state: dict) -> int:
        """Write the state that follows commit ``after``; `Conflict` if another one does.

        The file is written under another name and renamed to one that must be free, so it is there whole or not at all."""
        sc = self.spark.sparkContext
        fs, p = self._at(f"{after + 1:010d}.json")
        p = fs.makeQualified(p)
        part = fs.makeQualified(self._at(f"_{after + 1:010d}-{uuid.uuid4().hex}")[1])
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = sc._jvm.org.apache.hadoop.fs
        free = sc._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        try:
            jvm.FileContext.getFileContext(p.toUri(), sc._jsc.hadoopConfiguration()).rename(part, p, free)
        except Py4JJavaError as e:
            if fs.exists(part):
                fs.delete(part, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"{self.path}: commit {after + 1} is taken") from e
            raise
        return after + 1

    def delete(self, *paths: str) -> None:
        """Remove tables that no commit lists any more."""
        for path in paths:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
