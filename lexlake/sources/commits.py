"""A change source: commits of a version-controlled corpus as a Spark data source, for batches and streams.

A feed is a folder of files <number>_<commit>_<seconds since 1970>.diff, numbers from 1 on, each the output of `git diff --name-status -z`
of one commit against the one before. A file is written under another name first and renamed, so that a reader never sees half of one.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .changes import name_status

CHANGES = "number long, commit string, committed_at timestamp, status string, path string, old_path string"


@dataclass
class Commit(InputPartition):
    number: int
    commit: str
    seconds: int
    path: str


def commits_of(path: str, after: int = 0, upto: int | None = None) -> list[Commit]:
    """The commits of a feed by number, without those up to `after` and from past `upto` on; a folder that isn't there has none."""
    store, root = fs.FileSystem.from_uri(path)
    found = []
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        parts = f.base_name.removesuffix(".diff").split("_")
        if f.base_name.endswith(".diff") and len(parts) == 3 and parts[0].isdigit() and parts[2].isdigit() and after < int(parts[0]) <= (upto or int(parts[0])):
            found.append(Commit(int(parts[0]), parts[1], int(parts[2]), f.path))
    return sorted(found, key=lambda c: c.number)


class _Rows:
    """Reads commits in the tasks, one to a partition."""

    def __init__(self, path: str):
        self.path = path

    def read(self, partition: Commit | None) -> Iterator[tuple]:
        if partition is None:  # a feed without commits
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.path) as f:
            raw = f.read().decode("utf-8", "replace")
        at = datetime.datetime.fromtimestamp(partition.seconds, datetime.UTC)
        for status, path, old in name_status(raw):
            yield partition.number, partition.commit, at, status, path, old


class _Batch(_Rows, DataSourceReader):
    def __init__(self, path: str, after: int):
        super().__init__(path)
        self.after = after

    def partitions(self) -> list[Commit]:
        return commits_of(self.path, self.after)


class _Stream(_Rows, DataSourceStreamReader):
    """Offsets are numbers of commits: what a query has committed is its cursor."""

    def __init__(self, path: str, after: int):
        super().__init__(path)
        self.after = after

    def initialOffset(self) -> dict:
        return {"commit": self.after}

    def latestOffset(self) -> dict:
        return {"commit": max((c.number for c in commits_of(self.path)), default=self.after)}

    def partitions(self, start: dict, end: dict) -> list[Commit]:
        return commits_of(self.path, start["commit"], end["commit"]) if end["commit"] > start["commit"] else []

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the checkpoint has the cursor, and feeds keep their files."""


class CommitFeed(DataSource):
    """Options: path (an address with its scheme), after (number of the last commit that isn't wanted, 0 unless given)."""

    @classmethod
    def name(cls) -> str:
        return "commit_feed"

    def schema(self) -> str:
        return CHANGES

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], int(self.options.get("after", 0)))

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], int(self.options.get("after", 0)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommitFeed)


def head(changes: DataFrame) -> DataFrame:
    """One row (commit, committed_at) of the newest commit of a feed."""
    return changes.agg(F.max_by("commit", "number").alias("commit"), F.max_by("committed_at", "number").alias("committed_at"))


def folded(changes: DataFrame) -> DataFrame:
    """(status, path, old_path) of several commits as one change feed: of each path what its last commit says.

    A move within the range stays a move of its old path where no later commit touches either; else it is a delete and an upsert.
    """
    again = changes.groupBy("path").agg(F.max("number").alias("last"))
    gone = changes.select(F.col("old_path").alias("path"), "number").where("path is not null").groupBy("path").agg(F.max("number").alias("left"))
    moved = changes.where("status = 'move'")
    touched = changes.select("number", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path"))
    many = touched.groupBy("path").agg(F.count("*").alias("n"))
    whole = moved.join(many, "path").where("n = 1").select("number", "status", "path", "old_path").join(many.select(F.col("path").alias("old_path"), F.col("n").alias("m")), "old_path").where("m = 1").select("status", "path", "old_path")
    single = touched.join(whole.select(F.explode(F.array("path", "old_path")).alias("path")), "path", "left_anti").select("path").distinct()
    last = changes.join(again, "path").where("number = last").select("path", "number", "status").dropDuplicates(["path"])
    state = single.join(last, "path", "left").join(gone, "path", "left")
    status = F.when(F.col("status").isNull() | (F.coalesce("left", F.lit(-1)) > F.coalesce("number", F.lit(-1))), "delete").when(F.col("status") == "delete", "delete").otherwise("upsert")
    return whole.unionByName(state.select(status.alias("status"), "path", F.lit(None).cast("string").alias("old_path")))
