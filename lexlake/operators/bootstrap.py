"""From files to chunks: resume, parse, identify, settle ownership, chunk, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import payload
from ..sources.html import captured_pages
from ..sources.scratch import stored
from . import chunking, identity, ownership, parsing
from .ingestion import resume_skip, stale_points, watermark

#: Files are taken in this order: by collection, then name.
ORDER = ("collection", "path")


def parsed_acts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acts, articles) of files (path, collection, text).

    acts: (doc, title, subtitle, first_text, error); articles as chunking.chunk_articles takes them. A file that can't be
    read has an error and no articles; it never fails the job.
    """
    kind, body = payload(F.col("text"))
    read = files.select(F.col("path").alias("doc"), kind.alias("format"), body.alias("body"), F.col("text").isNull().alias("broken"))
    # Files are dealt out whole, before they become lines: the windows over a file's lines then need no shuffle of lines.
    good = read.where("not broken").repartition("doc")
    events = stored(parsing.line_events(parsing.lines(good.where("format = 'markdown'"), "doc", "body")))
    plain = parsing.article_paragraphs(parsing.finish_articles(parsing.articles(events)), with_articles=True)
    read_pages = stored(captured_pages(good.where("format <> 'markdown'").select("doc", "body"), "doc", "body"))
    pages = read_pages.where("error is null")
    captured = pages.select("id", (F.col("pos") + 1).alias("article_no"), "number", F.lit("akn").alias("style"), F.coalesce("annex", F.lit("")).alias("path"), F.col("text").alias("body")).withColumnRenamed("id", "doc")
    captured = parsing.article_paragraphs(parsing.finish_articles(captured), with_articles=True)
    every = plain.unionByName(captured)
    order = F.struct("paragraph_no", "number", "text")
    found = every.groupBy("doc", "article_no").agg(F.first("article").alias("article"), F.first("path").alias("path"), F.first("rubric").alias("rubric"), F.sort_array(F.collect_list(order)).alias("all"))
    arts = found.select("doc", "article_no", F.col("article").alias("number"), "path", "rubric", F.transform("all", lambda p: F.struct(p["number"].alias("number"), p["text"].alias("text"))).alias("paragraphs"))
    heads = parsing.act_heads(events).unionByName(pages.groupBy(F.col("id").alias("doc")).agg(F.first("title").alias("title"), F.first("subtitle").alias("subtitle")))
    first = arts.groupBy("doc").agg(F.min_by(F.try_element_at("paragraphs", F.lit(1))["text"], "article_no").alias("first_text"))
    failed = read_pages.where("error is not null").select(F.col("id").alias("doc"), F.col("error").alias("page_error"))
    acts = read.join(failed, "doc", "left").select("doc", F.when(F.col("broken"), "unreadable").otherwise(F.col("page_error")).alias("error")).join(heads, "doc", "left").join(first, "doc", "left")
    return acts.select("doc", "title", "subtitle", "first_text", "error"), arts


def bootstrap(files: DataFrame, done: DataFrame, acts: DataFrame | None = None, order: tuple[str, ...] = ORDER) -> dict[str, DataFrame]:
    """The tables of one run over files (path, collection, text, sha), without those that `done` (path, sha) has.

    acts: a row for each act that the run met and changed, with its owner's file and its status; files: every file with sha, act_ref and
    outcome (processed, resume_skipped, duplicate, failed) and error; chunks: of the acts' own files. With `acts` of earlier
    runs (act_ref, file_path, status and the rest; a null file_path gives the act away) an act stays with its file: another one is a
    duplicate and adds only its status, where that isn't the default. Nothing is collected, and the tables are stored
    between the steps.
    """
    fresh = stored(resume_skip(files, done, "path", "sha"))
    parsed, articles = parsed_acts(fresh)
    articles = stored(articles)
    named = parsed.join(fresh.select(F.col("path").alias("doc"), "collection", "sha"), "doc")
    kind = identity.type_of_collection(F.col("collection"))
    named = identity.with_identity(named, F.col("title"), F.col("subtitle"), F.col("first_text"), F.col("doc"), kind, "ref").withColumn("status", identity.status_of(F.col("doc")))
    named = stored(named.withColumn("act_ref", F.when(F.col("error").isNull(), F.col("ref.act_ref"))).withColumnRenamed("doc", "path"))
    held = files.sparkSession.createDataFrame([], ownership.ACTS) if acts is None else acts
    owned, met = ownership.settle(named.where("act_ref is not null").select("path", "act_ref", "collection", "status"), held, list(order))
    known = stored(named.join(owned.select("path", "owner"), "path", "left"))
    met = stored(met.withColumnRenamed("status", "act_status"))
    title = F.coalesce("subtitle", "title")
    indexed = known.where("owner").join(met.select("act_ref", "act_status"), "act_ref").select("act_ref", F.col("ref.act_type").alias("act_type"), F.col("ref.number").alias("number"), F.col("ref.year").alias("year"), F.col("ref.date").alias("date"), F.col("ref.source").alias("source"), title.alias("title"), "collection", F.col("act_status").alias("status"), F.col("path").alias("file_path"))
    indexed = stored(indexed)
    of_chunks = indexed.select(F.col("file_path").alias("doc"), "act_ref", "act_type", F.col("number").alias("act_number"), "year", "title", "collection", "status", "file_path")
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("owner"), "processed").otherwise("duplicate")
    skipped = files.join(fresh.select("path"), "path", "left_anti").select("path", "collection", "sha", F.lit(None).cast("string").alias("act_ref"), F.lit("resume_skipped").alias("outcome"), F.lit(None).cast("string").alias("error"))
    outcomes = known.select("path", "collection", "sha", "act_ref", outcome.alias("outcome"), "error").unionByName(skipped)
    changed = indexed
    if acts is not None:
        # Acts of earlier runs of which only duplicates were read.
        only = held.join(met.where("not indexed").select("act_ref", "act_status"), "act_ref").where("act_status <> status").withColumn("status", F.col("act_status"))
        changed = indexed.unionByName(only.select(*indexed.columns))
    return {"acts": changed, "files": outcomes, "chunks": chunking.chunk_articles(articles, of_chunks)}


def bootstrap_run(spark: SparkSession, folder: str, files: DataFrame) -> dict[str, DataFrame]:
    """A bootstrap that goes on from the state below a folder and writes it anew; returns the run's tables and `version`, one row."""
    version, before = ownership.read_state(spark, folder)
    run = bootstrap(files, before["files"].select("path", "sha"), before["acts"])
    return _written(spark, folder, version, before, run, stale=False)


def _written(spark: SparkSession, folder: str, version: int, before: dict[str, DataFrame], run: dict[str, DataFrame], stale: bool) -> dict[str, DataFrame]:
    run = {name: stored(table) for name, table in run.items()}
    ownership.write_state(spark, folder, version, ownership.merged(before, run, stale))
    return run


def delta(files: DataFrame, changes: DataFrame, acts: DataFrame, done: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables of the run, as bootstrap() gives them; acts and files after deletes and moves) of a change feed (status, path, old_path).

    files is the new snapshot, acts and done (path, sha, act_ref) the state before. Deletes and moves read no file
    (ownership.apply_feed); what is left is read in the order of paths. A path of the feed that the snapshot lacks has failed.
    """
    fed = ownership.apply_feed(changes, acts, done)
    after, upserts = stored(fed["acts"]), stored(fed["upserts"])
    held = after.withColumn("file_path", F.when(~F.col("released"), F.col("file_path")))
    run = bootstrap(files.join(upserts, "path", "left_semi"), fed["files"].select("path", "sha"), held.drop("released", "touched"), ("path",))
    lost = upserts.join(files.select("path"), "path", "left_anti").select("path", F.substring_index("path", "/", 1).alias("collection"), *(F.lit(None).cast("string").alias(c) for c in ("sha", "act_ref")), F.lit("failed").alias("outcome"), F.lit("unreadable").alias("error"))
    moved = after.where("touched").join(run["acts"].select("act_ref"), "act_ref", "left_anti")
    # An act whose owner is gone keeps the path in its row; it was given away within this run only.
    own = run["acts"].join(after.select("act_ref", F.col("file_path").alias("kept")), "act_ref", "left").withColumn("file_path", F.coalesce("file_path", "kept"))
    changed = own.select(*run["acts"].columns).unionByName(moved.select(*run["acts"].columns))
    return {"acts": changed, "files": run["files"].unionByName(lost), "chunks": run["chunks"]}, {"acts": after.drop("released", "touched"), "files": fed["files"]}


def delta_run(spark: SparkSession, folder: str, files: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """A delta that goes on from the state below a folder and writes it anew; returns the run's tables. Without a state there is
    nothing to go on from, which raises."""
    version, before = ownership.read_state(spark, folder)
    if not version:
        raise ValueError("no completed run to go on from")
    run, after = delta(files, changes, before["acts"], before["files"])
    return _written(spark, folder, version, {"acts": stored(after["acts"]), "files": stored(after["files"]), "chunks": before["chunks"]}, run, stale=True)


def run_counts(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of a run, of all files or by columns: total, processed, resume_skipped, duplicate, failed."""
    each = [F.count_if(F.col("outcome") == o).alias(o) for o in ("processed", "resume_skipped", "duplicate", "failed")]
    return files.groupBy(*(by or [])).agg(F.count("*").alias("total"), *each)


def present_lots(chunks: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """(lot, n_chunks, present): whether all ids of a lot (lot, chunk_id) are stored (chunk_id)."""
    there = stored_ids.select("chunk_id").distinct().withColumn("there", F.lit(True))
    got = chunks.join(there, "chunk_id", "left")
    return got.groupBy("lot").agg(F.count("*").alias("n_chunks"), F.bool_and(F.coalesce("there", F.lit(False))).alias("present"))


def write_run(tables: dict[str, DataFrame], folder: str, version: str) -> dict[str, str]:
    """Chunks first, then acts, then the files' outcomes: whoever finds a file recorded as done finds its chunks. A run that
    is stopped between leaves no record of what it did, and running it again writes the same rows over."""
    out = {}
    for name in ("chunks", "acts", "files"):
        out[name] = f"{folder.rstrip('/')}/{name}-{version}"
        tables[name].write.mode("overwrite").parquet(out[name])
    return out


def index_collection(files: DataFrame, done: DataFrame, collection: str) -> dict[str, DataFrame]:
    """A run over one collection's files; one that isn't there raises."""
    some = files.where(F.col("collection") == collection)
    if some.isEmpty():
        raise ValueError(f"no such collection: {collection}")
    return bootstrap(some, done)


def delta_upserts(files: DataFrame, changes: DataFrame, acts: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Acts, chunks and stale chunk ids after the upserts of a change feed, files being the new snapshot; every path of the feed is read.

    An act stays with its file as long as that is in the snapshot; a changed file of another owner adds only its status,
    where that isn't the default, to the act and its chunks. Chunks of acts indexed again that weren't produced again go.
    """
    none = files.select("path", "sha").limit(0)
    held = acts.join(files.select(F.col("path").alias("file_path"), F.lit(True).alias("there")), "file_path", "left")
    held = held.withColumn("file_path", F.when(F.col("there"), F.col("file_path"))).drop("there")
    paths = changes.where("status = 'upsert'").select("path").distinct()
    run = bootstrap(files.join(paths, "path", "left_semi"), none, held.select(*acts.columns), ("path",))
    run = {name: stored(table) for name, table in run.items()}
    before = {"acts": acts, "chunks": chunks, "files": none.select("path", "sha", F.lit(None).cast("string").alias("act_ref"))}
    after = ownership.merged(before, run, stale=True)
    gone = stale_points(chunks, run["chunks"], "act_ref", "chunk_id").select("chunk_id")
    return {"acts": after["acts"], "chunks": after["chunks"], "stale": gone}


def required_watermark(runs: DataFrame) -> str:
    """The commit from which a delta goes on; without a completed run there is none, which raises."""
    found = watermark(runs).first()
    if found is None or found.commit_to is None:
        raise ValueError("no completed run to go on from")
    return found.commit_to


def processing_order(changes: DataFrame) -> DataFrame:
    """Changes with their step: deletes, then moves, then upserts, each by path."""
    step = F.when(F.col("status") == "delete", 0).when(F.col("status") == "move", 1).otherwise(2)
    return changes.withColumn("step", step).orderBy("step", "path")


def head_frame(spark: SparkSession, commit: str, committed_at: str) -> DataFrame:
    """What a corpus says of itself, one row: (commit, committed_at)."""
    return spark.createDataFrame([(commit, committed_at)], "commit string, committed_at string").withColumn("committed_at", F.to_timestamp("committed_at"))
