"""Which file owns an act, from run to run: a state of acts and files that every run reads, changes and writes anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.tables import read_or_empty
from .identity import status_of
from .ingestion import DEFAULT_STATUS, latest_wins

ACTS = "act_ref string, act_type string, number string, year int, date date, source string, title string, collection string, status string, file_path string"
FILES = "path string, sha string, act_ref string"
CHUNKS = "chunk_id string, act_ref string, act_type string, act_title string, article string, commi array<string>, collection string, status string, file_path string, header string, text string"
STATE = {"chunks": CHUNKS, "acts": ACTS, "files": FILES}


def settle(found: DataFrame, held: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files of a run (path, act_ref, status, columns of `order`) against acts of earlier runs (act_ref, file_path, status).

    An act stays with the file that holds it; one that no file holds (a null file_path, or no row) goes to its first file in order.
    The owner's file sets the act's status, a duplicate only one other than the default, each in its turn. Returns the files with
    `owner`, whether it is theirs, and a row for each act met: act_ref, file_path, status, indexed (whether the owner's file was
    among those read). Aggregates and joins with a row for each act; an act of any number of files is never held in a task.
    """
    at = F.struct(*order)
    first = found.groupBy("act_ref").agg(F.min_by("path", at).alias("first"))
    owners = first.join(held.select("act_ref", F.col("file_path").alias("held_by"), F.col("status").alias("held_status")), "act_ref", "left")
    owners = owners.select("act_ref", F.coalesce("held_by", "first").alias("file_path"), "held_status")
    files = stored(found.join(owners, "act_ref").withColumn("owner", F.col("path") == F.col("file_path")))
    # The last file that sets the status decides.
    sets = F.col("owner") | (F.col("status") != DEFAULT_STATUS)
    met = files.groupBy("act_ref", "file_path", "held_status").agg(F.max_by(F.when(sets, F.col("status")), F.when(sets, at)).alias("last"), F.bool_or("owner").alias("indexed"))
    return files.drop("file_path", "held_status"), met.select("act_ref", "file_path", F.coalesce("last", "held_status").alias("status"), "indexed")


def apply_feed(changes: DataFrame, acts: DataFrame, files: DataFrame, state_of: Callable[[Column], Column] = status_of) -> dict[str, DataFrame]:
    """The deletes and moves of a change feed (status, path, old_path), without reading a file: acts, files, upserts.

    Deletes come first: an act in force whose owner goes is abrogated, and any file read in this run may take it (`released`). A
    moved owner takes act, collection and the status of its new folder along; a moved duplicate sets a status other than the default,
    each in its turn by new path. A move from a path that no run has recorded, or whose act is gone or released,
    becomes an upsert of the new path. upserts are all paths to be read; `touched` marks acts whose chunks change.
    """
    gone = changes.where("status = 'delete'").select(F.col("path").alias("file_path")).distinct().withColumn("released", F.lit(True))
    flip = F.col("released") & (F.col("status") == DEFAULT_STATUS)
    acts = acts.join(gone, "file_path", "left").withColumn("released", F.coalesce("released", F.lit(False)))
    acts = acts.withColumns({"status": F.when(flip, "abrogato").otherwise(F.col("status")), "touched": flip})
    moves = changes.where("status = 'move'").select("path", "old_path").dropDuplicates(["old_path"])
    known = moves.join(files.select(F.col("path").alias("old_path"), "sha", "act_ref"), "old_path", "left")
    known = known.join(acts.select("act_ref", F.col("file_path").alias("held_by"), "released"), "act_ref", "left")
    known = stored(known.withColumn("follows", F.col("sha").isNotNull() & F.coalesce(~F.col("released"), F.lit(False))).withColumn("state", state_of(F.col("path"))))
    owner = F.col("held_by") == F.col("old_path")
    sets = owner | (F.col("state") != DEFAULT_STATUS)
    met = known.where("follows").groupBy("act_ref").agg(F.max(F.when(owner, F.col("path"))).alias("now_at"), F.max_by(F.when(sets, F.col("state")), F.when(sets, F.col("path"))).alias("last"))
    last = F.coalesce("last", "status")
    columns = acts.columns
    new = {"touched": F.col("touched") | F.col("now_at").isNotNull() | (last != F.col("status")), "status": last, "file_path": F.coalesce("now_at", "file_path")}
    if "collection" in columns:
        new["collection"] = F.coalesce(F.substring_index("now_at", "/", 1), "collection")
    acts = acts.join(met, "act_ref", "left").withColumns(new).select(*columns)
    left = files.join(gone.select(F.col("file_path").alias("path")).union(known.select("old_path")), "path", "left_anti")
    files = latest_wins(left, known.where("follows").select("path", "sha", "act_ref"), ["path"])
    upserts = changes.where("status = 'upsert'").select("path").union(known.where("not follows").select("path")).distinct()
    return {"acts": acts, "files": files.select("path", "sha", "act_ref"), "upserts": upserts}


def merged(before: dict[str, DataFrame], run: dict[str, DataFrame], stale: bool) -> dict[str, DataFrame]:
    """The state after a run that returned acts (changed ones, whole rows), files (path, sha, act_ref, outcome) and chunks.

    Chunks of a changed act carry its status, folder and file, also those that weren't written again. With `stale`, chunks
    of acts indexed again that weren't produced again go; else they stay until a later run.
    """
    acts = latest_wins(before["acts"], run["acts"].select(*before["acts"].columns), ["act_ref"])
    done = run["files"].where("outcome in ('processed', 'duplicate')").select("path", "sha", "act_ref")
    chunks = latest_wins(before["chunks"], run["chunks"].select(*before["chunks"].columns), ["chunk_id"])
    if stale:
        again = before["chunks"].join(run["chunks"].select("act_ref").distinct(), "act_ref", "left_semi").select("chunk_id")
        chunks = chunks.join(again.join(run["chunks"].select("chunk_id"), "chunk_id", "left_anti"), "chunk_id", "left_anti")
    new = run["acts"].select("act_ref", *(F.col(c).alias(f"act_{c}") for c in ("status", "collection", "file_path")))
    carried = {c: F.coalesce(f"act_{c}", c) for c in ("status", "collection", "file_path")}
    chunks = chunks.join(new, "act_ref", "left").withColumns(carried).select(*before["chunks"].columns)
    return {"chunks": chunks, "acts": acts.select(*before["acts"].columns), "files": latest_wins(before["files"], done, ["path"]).select("path", "sha", "act_ref")}


def read_state(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame]]:
    """(version, tables) of the newest complete version below a folder; version 0, empty tables, where there is none."""
    version = read_or_empty(spark, f"{folder}/versions", "version long").agg(F.max("version")).first()[0] or 0
    if not version:
        return 0, {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}
    return version, {name: spark.read.schema(schema).parquet(f"{folder}/{name}-{version}") for name, schema in STATE.items()}


def write_state(spark: SparkSession, folder: str, version: int, tables: dict[str, DataFrame]) -> int:
    """Chunks, then acts, then files as a new version; it counts only from the row that is added last. A run that is stopped
    before leaves the old version as it was and is done again under the same number."""
    for name, schema in STATE.items():
        columns = [f.strip().split(" ")[0] for f in schema.split(", ")]
        tables[name].select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}-{version + 1}")
    spark.range(1).select(F.lit(version + 1).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return version + 1
