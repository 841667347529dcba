"""Registered queries about runs: what one run leaves for the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ingestion as ing
from ..operators import ownership as own
from ..streaming import events as ev
from ..streaming import frames as fr
from .queries import _FILES, _SNAP, Tables, _changes, _files, query

#: Files (path, key, status) of a run with `held` (key, owner, status) of the runs before, taken in the order of `at`; what is settled.
_SETTLED = """{n}_o AS (SELECT r.key, coalesce(any_value(h.owner), min({at})[2]) AS owner, any_value(h.status) AS was FROM {n} r LEFT JOIN {held} h ON h.key = r.key GROUP BY 1),
{n}_s AS (SELECT key, owner, coalesce(arg_max(status, {at}) FILTER (path = owner OR status <> 'vigente'), any_value(was)) AS status, count(*) FILTER (path = owner) AS n_processed, count(*) FILTER (path <> owner) AS n_duplicate FROM {n} JOIN {n}_o USING (key) GROUP BY 1, 2)"""
_NOTHING = "(SELECT NULL::VARCHAR AS key, NULL::VARCHAR AS owner, NULL::VARCHAR AS status WHERE false)"


def _run(found: DataFrame, acts: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with owner, acts after, counts by act) of a run over identified files."""
    files, met = own.settle(found, acts, order)
    after = ing.latest_wins(acts.select("act_ref", "file_path", "status"), met.select("act_ref", "file_path", "status"), ["act_ref"])
    counts = files.groupBy("act_ref").agg(F.count_if("owner").alias("n_processed"), F.count_if(~F.col("owner")).alias("n_duplicate"))
    return files, after, counts


def _reported(acts: DataFrame, counts: DataFrame) -> DataFrame:
    n = (F.coalesce(c, F.lit(0)).alias(c) for c in ("n_processed", "n_duplicate"))
    return acts.join(counts, "act_ref", "left").select(F.col("act_ref").alias("key"), "file_path", "status", *n)


def _no_acts(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "act_ref string, file_path string, status string")


def _state_after_first(t: Tables, rows: str) -> tuple[DataFrame, DataFrame]:
    """Acts and files that a first run over some documents leaves."""
    first = _files(t).where(rows).select("path", "source", F.col("key").alias("act_ref"), "status", F.md5("text").alias("sha"))
    files, acts, _ = _run(first, _no_acts(first), ["source", "path"])
    return acts, files.select("path", "sha", "act_ref")


@query(f"""WITH {_FILES}, s1 AS (SELECT *, md5(text) AS sha FROM f WHERE doc_id % 3 <> 0), {_SETTLED.format(n='s1', at='(source, path)', held=_NOTHING)},
s2 AS (SELECT *, md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END) AS sha FROM f), r AS (SELECT * FROM s2 WHERE (path, sha) NOT IN (SELECT path, sha FROM s1)), {_SETTLED.format(n='r', at='(source, path)', held='s1_s')}
SELECT coalesce(r_s.key, s1_s.key) AS key, coalesce(r_s.owner, s1_s.owner) AS file_path, coalesce(r_s.status, s1_s.status) AS status, coalesce(r_s.n_processed, 0) AS n_processed, coalesce(r_s.n_duplicate, 0) AS n_duplicate FROM s1_s FULL JOIN r_s ON r_s.key = s1_s.key""")
def resumed_bootstrap(t: Tables) -> DataFrame:
    """ING-01, JON-02: a second snapshot with a third more files, a fifth of them changed, over the state that the first run left."""
    acts, done = _state_after_first(t, "doc_id % 3 <> 0")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    second = _files(t).select("path", "source", F.col("key").alias("act_ref"), "status", F.md5(text).alias("sha"))
    _, after, counts = _run(ing.resume_skip(second, done, "path", "sha"), acts, ["source", "path"])
    return _reported(after, counts)


def _folder_state(path: Column) -> Column:
    return F.when(F.length(path) % 3 == 0, "abrogato").otherwise("vigente")


@query(f"""WITH {_SNAP}, s1 AS (SELECT *, md5(text) AS sha FROM f WHERE doc_id % 10 <> 0), {_SETTLED.format(n='s1', at='(source, path)', held=_NOTHING)},
a2 AS (SELECT key, owner, d.path IS NOT NULL AS released, CASE WHEN d.path IS NOT NULL AND s.status = 'vigente' THEN 'abrogato' ELSE s.status END AS status FROM s1_s s LEFT JOIN (SELECT path FROM ch WHERE status = 'delete') d ON d.path = s.owner),
mv AS (SELECT c.path, c.old_path, s1.key, s1.sha, NOT a2.released AS follows, c.old_path = a2.owner AS own, CASE WHEN length(c.path) % 3 = 0 THEN 'abrogato' ELSE 'vigente' END AS state FROM ch c JOIN s1 ON s1.path = c.old_path JOIN a2 ON a2.key = s1.key WHERE c.status = 'move'),
m AS (SELECT key, max(path) FILTER (own) AS at, arg_max(state, path) FILTER (own OR state <> 'vigente') AS state FROM mv WHERE follows GROUP BY 1),
a3 AS (SELECT a2.key, coalesce(m.at, a2.owner) AS path, released, coalesce(m.state, a2.status) AS status FROM a2 LEFT JOIN m ON m.key = a2.key),
done AS (SELECT path, sha FROM s1 WHERE path NOT IN (SELECT path FROM ch WHERE status = 'delete') AND path NOT IN (SELECT old_path FROM mv) AND path NOT IN (SELECT path FROM mv WHERE follows) UNION ALL SELECT path, sha FROM mv WHERE follows),
up AS (SELECT path FROM ch WHERE status = 'upsert' UNION SELECT path FROM mv WHERE NOT follows),
n2 AS (SELECT CASE WHEN doc_id % 11 = 0 THEN concat('moved/', path) ELSE path END AS path, key, status, md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END) AS sha FROM f WHERE doc_id % 7 <> 0),
r AS (SELECT n2.* FROM n2 JOIN up ON up.path = n2.path WHERE (n2.path, n2.sha) NOT IN (SELECT path, sha FROM done)), held AS (SELECT key, CASE WHEN NOT released THEN path END AS owner, status FROM a3), {_SETTLED.format(n='r', at="('', path)", held='held')}
SELECT coalesce(r_s.key, a3.key) AS key, coalesce(r_s.owner, a3.path) AS file_path, coalesce(r_s.status, a3.status) AS status, coalesce(r_s.n_processed, 0) AS n_processed, coalesce(r_s.n_duplicate, 0) AS n_duplicate FROM a3 FULL JOIN r_s ON r_s.key = a3.key""")
def delta_upserts(t: Tables) -> DataFrame:
    """ING-05, ING-04, SNK-03, JON-02: a change feed over the state that a first run left: deletes give acts away, moves take them along or
    become upserts, upserts are settled against who holds an act."""
    acts, done = _state_after_first(t, "doc_id % 10 <> 0")
    fed = own.apply_feed(_changes(t), acts, done, _folder_state)
    path = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    second = _files(t).where("doc_id % 7 <> 0").select(path.alias("path"), F.col("key").alias("act_ref"), "status", F.md5(text).alias("sha"))
    fresh = ing.resume_skip(second.join(fed["upserts"], "path", "left_semi"), fed["files"], "path", "sha")
    held = fed["acts"].withColumn("file_path", F.when(~F.col("released"), F.col("file_path")))
    _, settled, counts = _run(fresh, held, ["path"])
    kept = fed["acts"].select("act_ref", F.col("file_path").alias("kept"))
    return _reported(settled.join(kept, "act_ref", "left").withColumn("file_path", F.coalesce("file_path", "kept")).drop("kept"), counts)


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_no, CASE WHEN role = 'user' THEN 'status' ELSE 'token' END AS kind, text FROM conversations""")
def frame_streams(t: Tables) -> DataFrame:
    """SNK-12, STM-07: the turns of conversations written as event frames, cut into pieces of bytes anywhere, and read back."""
    frame = ev.frames(F.when(F.col("role") == "user", "status").otherwise("token"), F.struct("text"))
    whole = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "").alias("s"))
    raw, width = F.col("s").cast("binary"), (F.col("conv_id") % 37 + 3).cast("int")
    cuts = F.sequence(F.lit(0), F.floor((F.octet_length("s") - 1) / width).cast("int"))
    pieces = whole.select(F.col("conv_id").cast("string").alias("stream_id"), F.posexplode(F.transform(cuts, lambda k: F.substring(raw, k * width + 1, width))).alias("seq", "piece"))
    out = fr.decoded_frames(pieces)
    return out.select(F.col("stream_id").cast("long").alias("conv_id"), "frame_no", "kind", F.get_json_object("data", "$.text").alias("text"))
