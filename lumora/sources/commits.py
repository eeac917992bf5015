"""Commits by atomic rename: stores replaced as a whole, logs of committed parts, several tables published together.

A commit is a small file whose name is its number; it appears by one rename that fails if the number is taken. What a
commit names is written before, what it replaces goes later, so a writer that stops anywhere leaves the last commit whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class CommitTaken(RuntimeError):
    """Another writer has committed in the meantime."""


class Commits:
    """The numbered commits of a folder, each a JSON value."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int):
        stream = self._fs.open(self._path(f"{self.path}/_commits/{number:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def add(self, value, after: int) -> int:
        """Commits value as number after + 1; CommitTaken if that is there."""
        new = self._path(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(json.dumps(value).encode())
        out.close()
        try:
            self._context.rename(new, self._path(f"{self.path}/_commits/{after + 1:010d}"), self._rename)
        except Exception as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise CommitTaken(f"{self.path}: commit {after + 1} is there") from e
            raise
        return after + 1

    def last(self) -> tuple[int, object]:
        """(number, value) of the last commit; (0, None) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def forget(self, number: int) -> None:
        self._fs.delete(self._path(f"{self.path}/_commits/{number:010d}"), False)

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def folders(self) -> set[str]:
        """What lies beside the commits, named by one or not."""
        here = self._path(self.path)
        return {s.getPath().getName() for s in self._fs.listStatus(here)} - {"_commits"} if self._fs.exists(here) else set()


class VersionedStore:
    """A table, or several (kinds), replaced as a whole: every version is a folder, the last commit names the one that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    def _folder(self, version: int | None) -> str:
        folder = self.commits.last()[1] if version is None else self.commits.read(version)
        if folder is None:
            raise FileNotFoundError(f"{self.commits.path} has no version")
        return f"{self.commits.path}/{folder}"

    def version(self) -> int:
        return self.commits.last()[0]

    def read(self, version: int | None = None, kind: str | None = None) -> DataFrame:
        """The rows of a version, by default the current one; the frame stays on it whatever is published later."""
        folder = self._folder(version)
        if kind is None:
            return self.spark.read.parquet(folder)
        rows = self.spark.read.option("basePath", folder).parquet(f"{folder}/kind={kind}")
        return rows.select(f"{kind}.*")

    def publish(self, rows: DataFrame, good: Callable[[DataFrame], bool] | None = None, by: str | None = None) -> bool:
        """Writes rows as a new version, and makes it the current one if good(rows as written) holds; else nothing changes."""
        number, folder = self.version(), f"v-{uuid.uuid4().hex}"
        out = rows.write if by is None else rows.write.partitionBy(by)
        out.parquet(f"{self.commits.path}/{folder}")
        if good is not None and not good(self.spark.read.parquet(f"{self.commits.path}/{folder}")):
            self.commits.delete(folder)
            return False
        self.commits.add(folder, number)
        return True

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the last versions, and what writers that stopped have left. Readers of an older version must have ended, as must writers."""
        numbers = self.commits.numbers()
        live = {self.commits.read(n) for n in numbers[-keep:]}
        for n in numbers[:-keep]:
            self.commits.forget(n)
        for folder in self.commits.folders() - live:
            self.commits.delete(folder)


class CommitLog:
    """A table that grows by committed parts: a part that isn't in the log doesn't count, whatever its files are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    def parts(self) -> list[dict]:
        return [self.commits.read(n) for n in self.commits.numbers()]

    def append(self, rows: DataFrame, by: str | None = None, **notes) -> int:
        """Writes rows as one part (in a folder for each value of by) and commits it with its notes."""
        number, folder = self.commits.last()[0], f"p-{uuid.uuid4().hex}"
        (rows.write if by is None else rows.write.partitionBy(by)).parquet(f"{self.commits.path}/{folder}")
        return self.commits.add({"folder": folder, **notes}, number)

    def read(self, schema) -> DataFrame:
        """The committed rows."""
        out = None
        for part in self.parts():  # each has folders of its own
            rows = self.spark.read.schema(schema).parquet(f"{self.commits.path}/{part['folder']}")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out


def resumed(todo: DataFrame, step: Callable[[DataFrame], DataFrame], log: CommitLog, key: str = "id", batch_rows: int = 100_000, after_batch: Callable[[int], None] | None = None) -> int:
    """Runs step over what of todo (key, ...) the log doesn't have yet, in batches of about batch_rows, each committed when it is whole. Returns how many batches ran.

    A run that stops loses the batch that it was at, at most; the next one goes on with what is missing, and repeats nothing that
    is committed. step's rows have the key. Keys are dealt to batches by hash; null keys are left out, repeated ones are one row each of one batch.
    """
    done = log.parts()
    rest = todo.where(f"{key} is not null")
    if done:
        have = log.spark.read.parquet(*(f"{log.commits.path}/{p['folder']}" for p in done)).select(key)
        rest = rest.join(have, key, "left_anti")
    batches = -(-rest.count() // batch_rows)
    for i in range(batches):
        log.append(step(rest.where(f"pmod(xxhash64({key}), {batches}) = {i}")), batch=i, of=batches)
        if after_batch is not None:
            after_batch(i)
    return batches
