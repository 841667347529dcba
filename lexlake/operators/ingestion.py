"""Ingestion: ownership, status, resume, change feeds, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..sources.scratch import stored

DEFAULT_STATUS = "vigente"


def first_file_wins(files: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each key's first file owns it; the others are duplicates."""
    w = Window.partitionBy(key).orderBy(*order)
    return files.withColumn("owner", F.row_number().over(w) == 1)


def status_override(files: DataFrame, key: str, status: str, order: Column) -> DataFrame:
    """(key, status): the last status of a key's files other than the default, else the default. One aggregate, no sort."""
    other = F.col(status) != DEFAULT_STATUS
    return files.groupBy(key).agg(F.coalesce(F.max_by(F.when(other, F.col(status)), F.when(other, order)), F.lit(DEFAULT_STATUS)).alias("status"))


def resume_skip(files: DataFrame, done: DataFrame, path: str, sha: str) -> DataFrame:
    """Files whose path and content hash aren't recorded as done: the rest is never parsed."""
    return files.join(done.select(path, sha), [path, sha], "left_anti")


def lot_durability(chunks: DataFrame, file: str, order: list[Column], lot: int = 256) -> DataFrame:
    """(file, n_chunks, durable_lot): chunks fill lots in order, a file is durable with the lot of its last chunk.

    Files are dealt into ranges of the order; a file's place is the sum of the ranges before its own, and of the files
    before it within. The one window over all ranges has a row for each range.
    """
    keys = [F.struct(c).alias(f"_o{k}") for k, c in enumerate(order)]
    per_file = chunks.groupBy(file, *keys).agg(F.count("*").alias("n_chunks"))
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{k}" for k in range(len(order))]
    ranged = stored(per_file.repartitionByRange(n, *names, file).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.sum("n_chunks").alias("s")).select("_range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    # A row for each range: at most the number of shuffle partitions.
    within = F.sum("n_chunks").over(Window.partitionBy("_range").orderBy(*names, file).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", within).join(F.broadcast(offsets), "_range")
    return placed.select(file, "n_chunks", F.floor((F.col("upto") + F.col("offset") - 1) / lot).cast("long").alias("durable_lot"))


def placed_within(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """The rows with their place, from 1 on, among those of the same key by `order`, a key of any size being dealt over many tasks.

    Rows go into ranges of (key, order); a place is what earlier ranges hold of the key and the number within its own. The window over
    the counts has a row for each range that a key lies in.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, key, order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n")).select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order))
    return ranged.withColumn("_within", within).join(counts, [key, "_range"]).withColumn(name, F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, path, old_path) between two snapshots (path, sha): upsert, delete, or move where a vanished path's content
    is at a new path. Among several of the same content the first vanished goes with the first new, and so on."""
    both = stored(old.select("path", F.col("sha").alias("old_sha")).join(new.select("path", F.col("sha").alias("new_sha")), "path", "full_outer").where("old_sha is null or new_sha is null or old_sha <> new_sha"))
    gone = both.where("new_sha is null").select(F.col("path").alias("old_path"), F.col("old_sha").alias("sha"))
    come = both.where("old_sha is null").select("path", F.col("new_sha").alias("sha"))
    pair = placed_within(gone, "sha", "old_path", "k").join(placed_within(come, "sha", "path", "k"), ["sha", "k"], "full_outer")
    moved = F.col("old_path").isNotNull() & F.col("path").isNotNull()
    status = F.when(moved, "move").when(F.col("path").isNull(), "delete").otherwise("upsert")
    changed = both.where("old_sha <> new_sha").select(F.lit("upsert").alias("status"), "path", F.lit(None).cast("string").alias("old_path"))
    return pair.select(status.alias("status"), F.coalesce("path", "old_path").alias("path"), F.when(moved, F.col("old_path")).alias("old_path")).unionByName(changed)


def apply_changes(acts: DataFrame, changes: DataFrame) -> DataFrame:
    """Acts (path, key, status) after a change feed: a deleted owner in force becomes abrogated and loses its path, a moved
    one takes the new path; nothing is parsed again."""
    c = changes.select(F.coalesce("old_path", "path").alias("path"), F.col("status").alias("change"), F.col("path").alias("new_path")).where("change <> 'upsert'")
    got = acts.join(c, "path", "left")
    status = F.when((F.col("change") == "delete") & (F.col("status") == DEFAULT_STATUS), "abrogato").otherwise(F.col("status"))
    path = F.when(F.col("change") == "delete", None).when(F.col("change") == "move", F.col("new_path")).otherwise(F.col("path"))
    return got.select("key", status.alias("status"), path.alias("path"))


def stale_points(existing: DataFrame, produced: DataFrame, key: str, point: str) -> DataFrame:
    """Existing points of the keys indexed again that weren't produced again."""
    again = existing.join(produced.select(key).distinct(), key, "left_semi")
    return again.join(produced.select(key, point), [key, point], "left_anti")


def latest_wins(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Full-row upsert: a change replaces the whole row, omitted values become null. No row is sorted: the newer side is kept by a maximum."""
    cols = [c for c in base.columns if c not in keys]
    both = base.select(*keys, F.lit(0).alias("_new"), *cols).unionByName(changes.select(*keys, F.lit(1).alias("_new"), *cols))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("_new")).alias("_row")).select(*keys, "_row.*")


def dry_run(files: DataFrame, group: str, key: str, order: list[Column], chars: Column) -> DataFrame:
    """By group, and of all (group null): files, duplicates skipped, characters of the rest, estimated tokens."""
    owned = first_file_wins(files, key, order)
    kept = F.sum(F.when(F.col("owner"), chars).otherwise(0)).cast("long")
    out = owned.rollup(group).agg(F.count("*").alias("files"), F.count_if(~F.col("owner")).alias("skipped"), kept.alias("chars"))
    return out.withColumn("est_tokens", token_estimate(F.col("chars")))


def watermark(runs: DataFrame) -> DataFrame:
    """The newest completed run's end commit."""
    return runs.where("status = 'completed' and commit_to is not null").agg(F.max_by("commit_to", "id").alias("commit_to"), F.max("id").alias("run_id"))


def set_status(acts: DataFrame, changes: DataFrame, order: str = "status") -> tuple[DataFrame, DataFrame]:
    """Acts (key, status, sha, ...) with the status of `changes` (key, status, sha), a null sha keeping the old one; and
    one row, n_rows: how many acts were met. Of several changes of an act the last by `order` counts."""
    new = changes.groupBy("key").agg(F.max_by(F.struct("status", "sha"), order).alias("new"))
    got = acts.join(new, "key", "left")
    after = got.withColumns({"status": F.coalesce("new.status", "status"), "sha": F.coalesce("new.sha", "sha")}).select(*acts.columns)
    return after, acts.join(new, "key", "left_semi").agg(F.count("*").alias("n_rows"))


def drop_progress(progress: DataFrame, changes: DataFrame, path: str = "file_path") -> DataFrame:
    """Checkpoint rows without those of deleted and moved files, which have to be done again where they now are."""
    gone = changes.where("status in ('delete', 'move')").select(F.coalesce("old_path", "path").alias(path)).distinct()
    return progress.join(gone, path, "left_anti")
