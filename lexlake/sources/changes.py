"""Change feeds of a version-controlled corpus."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def relevant(path: str) -> bool:
    """A text file inside a collection's folder."""
    return path.endswith(".md") and "/" in path


def name_status(raw: str) -> Iterator[tuple[str, str, str | None]]:
    """(status, path, old path) of `git diff --name-status -z` output: an unchanged rename is a move, an edited one a delete
    and an upsert; copies and all other states but deletion are upserts of the path that is left."""
    tokens = iter(raw.split("\0"))
    for state in tokens:
        if not state:
            continue
        first = next(tokens, "")
        second = next(tokens, "") if state[0] in "RC" else None
        if state == "R100" and relevant(first) and relevant(second):
            yield "move", second, first
        elif state[0] == "R":
            yield from ((s, p, None) for s, p in (("delete", first), ("upsert", second)) if relevant(p))
        elif relevant(path := first if second is None else second):
            yield "delete" if state[0] == "D" else "upsert", path, None


def changes_frame(spark: SparkSession, raw: str) -> DataFrame:
    return spark.createDataFrame(list(name_status(raw)), "status string, path string, old_path string")
