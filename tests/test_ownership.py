"""Owners of acts from run to run, against a loop over files one by one, and on real files."""

import random

import pytest
from pyspark.sql import functions as F

from lexlake.functions.text import blob_sha
from lexlake.operators import bootstrap as bs
from lexlake.operators import ownership as own

HEAD = "LEGGE 7 agosto 1990, n. 241\n====\n\n"
ACT = HEAD + "### Art. 1\nUno.\n\n### Art. 2\nDue.\n"
NEW = HEAD + "### Art. 1\nAltro.\n"
LAPSED = "DL decaduti"


def files(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string")
    return df.withColumns({"collection": F.substring_index("path", "/", 1), "sha": blob_sha(F.coalesce("text", F.lit("")))})


def state_of(path):
    return "abrogato" if len(path) % 3 == 0 else "vigente"


def one_by_one(acts, done, deletes, moves, reads):
    """What a loop over changes leaves: acts {ref: [path, status]}, outcomes {path: outcome}."""
    acts = {k: list(v) for k, v in acts.items()}
    done, holder, out = dict(done), {k: v[0] for k, v in acts.items()}, {}
    for p in sorted(deletes):
        ref = next((k for k, v in acts.items() if v[0] == p), None)
        if ref is not None:
            if acts[ref][1] == "vigente":
                acts[ref][1] = "abrogato"
            holder.pop(ref)
        done.pop(p, None)
    again = []
    for old, new in sorted(moves, key=lambda m: m[1]):
        ref = done.pop(old, None)
        if ref is None or ref not in holder:
            again.append(new)
            continue
        if holder[ref] == old:
            holder[ref] = acts[ref][0] = new
            acts[ref][1] = state_of(new)
        elif state_of(new) != "vigente":
            acts[ref][1] = state_of(new)
        done[new] = ref
    for path, ref, status in sorted(r for r in reads if r[0] in again or r[3] for r in [r[:3]]):
        if holder.get(ref, path) == path:
            holder[ref] = path
            acts[ref] = [path, status]
            out[path] = "processed"
        else:
            if status != "vigente":
                acts[ref][1] = status
            out[path] = "duplicate"
    return acts, out


def test_against_a_loop(spark):
    """Forty cases at once, each with its own paths and acts."""
    draw = random.Random(4)
    acts, done, changes, reads, want_acts, want_out = [], [], [], [], {}, {}
    for case in range(40):
        name = lambda k, case=case: f"c{case}/{'x' * (k % 4)}{k}"
        old = [name(k) for k in range(draw.randint(0, 8))]
        refs = {p: f"act{case}-{draw.randint(0, 3)}" for p in old}
        held = {}
        for p in draw.sample(old, len(old)):
            held.setdefault(refs[p], [p, draw.choice(["vigente", "abrogato", "decaduto"])])
        recorded = {p: r for p, r in refs.items() if draw.random() < 0.9 or held[r][0] == p}
        deletes = [p for p in old if draw.random() < 0.3]
        left = [p for p in old if p not in deletes]
        moves = [(p, f"c{case}/{'y' * draw.randint(0, 3)}m{k}") for k, p in enumerate(left) if draw.random() < 0.4]
        upserts = [p for p in left if p not in {m[0] for m in moves} and draw.random() < 0.4] + [name(k) for k in range(20, 20 + draw.randint(0, 4))]
        status = lambda: draw.choice(["vigente", "vigente", "abrogato", "decaduto"])
        read = [(p, refs.get(p, f"act{case}-{draw.randint(0, 4)}"), status(), True) for p in upserts] + [(new, refs[p], status(), False) for p, new in moves]
        a, o = one_by_one(held, recorded, deletes, moves, read)
        want_acts |= {k: tuple(v) for k, v in a.items()}
        want_out |= o
        acts += [(k, *v) for k, v in held.items()]
        done += [(p, "s", r) for p, r in recorded.items()]
        changes += [("delete", p, None) for p in deletes] + [("move", new, p) for p, new in moves] + [("upsert", p, None) for p in upserts]
        reads += [r[:3] for r in read]
    fed = own.apply_feed(
        spark.createDataFrame(changes, "status string, path string, old_path string"), spark.createDataFrame(acts, "act_ref string, file_path string, status string"),
        spark.createDataFrame(done, "path string, sha string, act_ref string"), lambda p: F.when(F.length(p) % 3 == 0, "abrogato").otherwise("vigente"),
    )
    found = spark.createDataFrame(reads, "path string, act_ref string, status string").join(fed["upserts"], "path", "left_semi")
    held = fed["acts"].withColumn("file_path", F.when(~F.col("released"), F.col("file_path")))
    got_files, met = own.settle(found, held, ["path"])
    assert {r.path: "processed" if r.owner else "duplicate" for r in got_files.collect()} == want_out
    after = {r.act_ref: (r.file_path, r.status) for r in fed["acts"].collect()}
    after |= {r.act_ref: (r.file_path, r.status) for r in met.collect()}
    assert after == want_acts and {"processed", "duplicate"} == {*want_out.values()}


def owners(run):
    return {r.act_ref: (r.file_path, r.status) for r in run.collect()}


def outcomes(run):
    return {r.path: r.outcome for r in run["files"].collect()}


def test_resumed_run_leaves_an_act_with_its_file(spark, tmp_path):
    """A new file that comes earlier in order is a duplicate of an act that an earlier run has; it only sets its status."""
    folder = str(tmp_path)
    bs.bootstrap_run(spark, folder, files(spark, [("B/1.md", ACT)]))
    run = bs.bootstrap_run(spark, folder, files(spark, [("A/1.md", NEW), ("B/1.md", ACT)]))
    assert outcomes(run) == {"A/1.md": "duplicate", "B/1.md": "resume_skipped"} and run["acts"].count() == 0 and run["chunks"].count() == 0
    run = bs.bootstrap_run(spark, folder, files(spark, [("A/1.md", NEW), (f"{LAPSED}/1.md", NEW), ("B/1.md", ACT)]))
    assert owners(run["acts"]) == {"legge-241-1990": ("B/1.md", "decaduto")}
    version, state = own.read_state(spark, folder)
    assert version == 3 and owners(state["acts"]) == {"legge-241-1990": ("B/1.md", "decaduto")}
    assert {r.path for r in state["files"].collect()} == {"A/1.md", "B/1.md", f"{LAPSED}/1.md"}
    assert {(r.chunk_id, r.status, r.file_path) for r in state["chunks"].collect()} == {(f"legge-241-1990#art-{k}#0", "decaduto", "B/1.md") for k in (1, 2)}


def test_delta_reads_the_owner_beside_an_earlier_duplicate(spark, tmp_path):
    """Both change: the owner's new text counts, whatever the order of the paths."""
    first = files(spark, [("B/1.md", ACT)])
    run = bs.bootstrap(first, first.select("path", "sha").limit(0))
    changes = spark.createDataFrame([("upsert", "A/1.md", None), ("upsert", "B/1.md", None)], "status string, path string, old_path string")
    new = files(spark, [("A/1.md", ACT), ("B/1.md", NEW)])
    after = bs.delta_upserts(new, changes, run["acts"], run["chunks"])
    assert owners(after["acts"]) == {"legge-241-1990": ("B/1.md", "vigente")}
    assert [r.text.rsplit(" ", 1)[-1] for r in after["chunks"].collect()] == ["Altro."]
    folder = str(tmp_path)
    bs.bootstrap_run(spark, folder, first)
    run = bs.delta_run(spark, folder, new, changes)
    assert outcomes(run) == {"A/1.md": "duplicate", "B/1.md": "processed"}
    _, state = own.read_state(spark, folder)
    assert [r.text.rsplit(" ", 1)[-1] for r in state["chunks"].collect()] == ["Altro."]


def test_delta_of_a_lapsed_duplicate_reaches_the_chunks(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        bs.delta_run(spark, folder, files(spark, []), spark.createDataFrame([], "status string, path string, old_path string"))
    bs.bootstrap_run(spark, folder, files(spark, [("B/1.md", ACT)]))
    changes = spark.createDataFrame([("upsert", f"{LAPSED}/1.md", None), ("upsert", "C/gone.md", None)], "status string, path string, old_path string")
    run = bs.delta_run(spark, folder, files(spark, [("B/1.md", ACT), (f"{LAPSED}/1.md", ACT)]), changes)
    assert outcomes(run) == {f"{LAPSED}/1.md": "duplicate", "C/gone.md": "failed"}
    _, state = own.read_state(spark, folder)
    assert owners(state["acts"]) == {"legge-241-1990": ("B/1.md", "decaduto")} and {r.status for r in state["chunks"].collect()} == {"decaduto"}


def test_delta_of_deletes_and_moves(spark, tmp_path):
    """A moved owner takes its chunks along without being read; a deleted one gives its act to whoever is read in this run."""
    folder = str(tmp_path)
    other = ACT.replace("241", "242")
    third = ACT.replace("241", "243")
    bs.bootstrap_run(spark, folder, files(spark, [("B/1.md", ACT), ("B/2.md", other), ("B/3.md", third)]))
    changes = [("move", f"{LAPSED}/1.md", "B/1.md"), ("delete", "B/2.md", None), ("upsert", "C/2.md", None), ("delete", "B/3.md", None), ("move", "C/never.md", "B/never.md")]
    new = files(spark, [(f"{LAPSED}/1.md", ACT), ("C/2.md", other.replace("### Art. 2\nDue.\n", "")), ("C/never.md", ACT.replace("241", "244"))])
    run = bs.delta_run(spark, folder, new, spark.createDataFrame(changes, "status string, path string, old_path string"))
    assert outcomes(run) == {"C/2.md": "processed", "C/never.md": "processed"}
    _, state = own.read_state(spark, folder)
    assert owners(state["acts"]) == {"legge-241-1990": (f"{LAPSED}/1.md", "decaduto"), "legge-242-1990": ("C/2.md", "vigente"), "legge-243-1990": ("B/3.md", "abrogato"), "legge-244-1990": ("C/never.md", "vigente")}
    got = {(r.chunk_id, r.status, r.file_path) for r in state["chunks"].collect()}
    assert got == {
        *((f"legge-241-1990#art-{k}#0", "decaduto", f"{LAPSED}/1.md") for k in (1, 2)), ("legge-242-1990#art-1#0", "vigente", "C/2.md"),
        *((f"legge-243-1990#art-{k}#0", "abrogato", "B/3.md") for k in (1, 2)), *((f"legge-244-1990#art-{k}#0", "vigente", "C/never.md") for k in (1, 2)),
    }
    assert {r.path for r in state["files"].collect()} == {f"{LAPSED}/1.md", "C/2.md", "C/never.md"}
    # Again with nothing changed: every file is known.
    again = bs.bootstrap_run(spark, folder, new)
    assert {*outcomes(again).values()} == {"resume_skipped"}


def test_a_stopped_run_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path)
    bs.bootstrap_run(spark, folder, files(spark, [("B/1.md", ACT)]))
    version, state = own.read_state(spark, folder)
    broken = dict(state, files=state["files"].withColumn("sha", F.raise_error(F.lit("stopped")).cast("string")))
    with pytest.raises(Exception, match="stopped"):
        own.write_state(spark, folder, version, broken)
    assert own.read_state(spark, folder)[0] == version == 1
    assert own.write_state(spark, folder, version, state) == 2 and own.read_state(spark, folder)[0] == 2
