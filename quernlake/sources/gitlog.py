"""A data source over git repositories: a row per commit and file."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_SCHEMA = "sha string, committed_at timestamp, author string, email string, message string, path string, added int, deleted int"


class GitLogSource(DataSource):
    """spark.read.format("gitlog").option("path", repository).option("partitions", n).load()"""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    """Partitions are stretches of the history, so that a long one is read in parallel."""

    def __init__(self, options: dict) -> None:
        self.path, self.n = options["path"], int(options.get("partitions", 4))

    def _git(self, *args: str) -> str:
        return subprocess.run(["git", "-c", "core.quotepath=off", "-C", self.path, *args], capture_output=True, text=True, check=True).stdout

    def partitions(self) -> list[InputPartition]:
        total = int(self._git("rev-list", "--count", "HEAD"))
        step = max(1, -(-total // self.n))
        return [InputPartition((k, step)) for k in range(0, total, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from datetime import UTC, datetime

        skip, count = partition.value
        mark = "\x1e"
        out = self._git("log", f"--skip={skip}", f"--max-count={count}", "--numstat", f"--format={mark}%H%x1f%ct%x1f%an%x1f%ae%x1f%s")
        for commit in out.split(mark)[1:]:
            head, *files = commit.strip("\n").split("\n")
            sha, at, author, email, message = head.split("\x1f")
            when = datetime.fromtimestamp(int(at), UTC)
            for line in [f for f in files if f.count("\t") >= 2] or ["\t\t"]:
                added, deleted, path = line.split("\t", 2)
                number = lambda x: int(x) if x.isdigit() else None
                yield sha, when, author, email, message, path or None, number(added), number(deleted)
