"""Admission of requests under two limits and two identities, of a whole table or batch by batch of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.scratch import stored
from ..sources.tables import read_or_empty

#: Fixed value: seconds after which to try again where too many are open.
SOON = 5


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), zone))


def seconds_to_midnight(ts: Column, zone: str) -> Column:
    """To the next local midnight, at least 1."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), zone)
    gone = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return F.greatest(F.lit(1), 86400 - gone)


def rightmost_address(header: Column, peer: Column) -> Column:
    """The last entry of a forwarding header, which the one trusted proxy has written; the peer's without header."""
    return F.when(F.coalesce(header, F.lit("")) == "", peer).otherwise(F.trim(F.substring_index(header, ",", -1)))


def visitor_id(cookie: Column, fresh: Column) -> tuple[Column, Column]:
    """(id, whether it is new): a cookie that is a UUID counts, else a fresh one."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(cookie), r"^urn:|^uuid:|[{}]", ""), "uuid:|-", "")
    ok = F.coalesce(digits.rlike("^[0-9a-f]{32}$"), F.lit(False))
    return F.when(ok, cookie).otherwise(fresh), ~ok


#: Rows that a fold reads: requests, and before them what earlier batches left of their identities (then `ip` is the identity, `end` its count of the day).
_ROWS = "group string, at long, kind int, id string, day int, end long, ip string, cookie string, left string"
_DECIDED = pa.schema([("kind", pa.int32()), ("id", pa.string()), ("verdict", pa.string()), ("who", pa.string()), ("day", pa.int32()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])
#: Kinds of rows: what was left, and requests.
LEFT, REQUEST = 0, 1
STATE = "who string, day int, n long, ends array<long>, at long"


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b), root being the smallest node reached.

    Large and small stars by turns, each a shuffle by node with a row for each link at most; rounds grow as the logarithm of the longest chain.
    """
    edges, was = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == was:
            break
        was = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = stored(large.join(low, "u").select(star.alias("e")).select("e.*").where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _timed(requests: DataFrame, zone: str, ttl: int) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    most = at + ttl * 1_000_000
    end = F.least(F.coalesce(F.unix_micros(F.col("done").cast("timestamp")), most), most)
    name = lambda kind: F.concat(F.lit(f"{kind}:"), F.coalesce(F.col(kind).cast("string"), F.lit("\0")))
    return requests.select("id", "ts", F.unix_date(local_day(F.col("ts"), zone)).alias("day"), at.alias("at"), end.alias("end"), name("ip").alias("ip"), name("cookie").alias("cookie"))


def _grouped(known: DataFrame, state: DataFrame, ttl: int) -> tuple[DataFrame, DataFrame]:
    """(requests, state) with the group in which verdicts can hang on each other.

    Linked are the two identities of a request on its day, and an identity's days where requests of the later one begin within
    ttl of the earlier one's last. So a group is bounded by who shares addresses and cookies within a day, not by how long the table is.
    """
    spot = lambda who: F.concat_ws("|", F.col(who), F.col("day").cast("string"))
    pairs = known.select(spot("ip").alias("a"), spot("cookie").alias("b")).distinct()
    each = known.select(F.col("ip").alias("who"), "day", "at").union(known.select("cookie", "day", "at"))
    span = each.groupBy("who", "day").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    span = span.unionByName(state.select("who", "day", F.col("at").alias("first"), F.col("at").alias("last"))).groupBy("who", "day").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    w = Window.partitionBy("who").orderBy("day")
    days = span.withColumns({"before": F.lag("day").over(w), "was": F.lag("last").over(w)}).where(F.col("first") - F.col("was") <= ttl * 1_000_000)
    over = days.select(spot("who").alias("a"), F.concat_ws("|", "who", F.col("before").cast("string")).alias("b"))
    roots = stored(connected(pairs.union(over)))
    of = lambda df, who: df.withColumn("node", spot(who)).join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("node", "root")
    return of(known, "ip"), of(state, "who")


def _folded(rows: DataFrame, day_most: int, open_most: int) -> DataFrame:
    """Verdicts of requests and what is left of identities, one after the other within a group. A task holds, of the group it is at, the
    counts of its identities' days and the ends of what is open."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, count, opened, seen = None, {}, {}, {}

        def left() -> list[tuple]:
            return [(LEFT, None, None, who, day, count.get((who, day), 0), sorted(opened.get(who, ()))) for who, day in seen.items()]

        for batch in got:
            out = []
            for g, at, kind, i, day, end, ip, cookie, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    out += left()
                    group, count, opened, seen = g, {}, {}, {}
                if kind == LEFT:
                    count[ip, day] = end
                    seen[ip] = max(day, seen.get(ip, day))
                    opened[ip] = [int(x) for x in ends.split(",") if x] if ends else opened.get(ip, [])
                    heapify(opened[ip])
                    continue
                both = (ip, cookie)
                for who in both:
                    seen[who] = day
                    heap = opened.setdefault(who, [])
                    while heap and heap[0] <= at:
                        heappop(heap)
                if any(count.get((who, day), 0) >= day_most for who in both):
                    out.append((REQUEST, i, "daily_limit", None, None, None, None))
                elif any(len(opened[who]) >= open_most for who in both):
                    out.append((REQUEST, i, "concurrency_limit", None, None, None, None))
                else:
                    out.append((REQUEST, i, "admitted", None, None, None, None))
                    for who in both:
                        count[who, day] = count.get((who, day), 0) + 1
                        if end > at:
                            heappush(opened[who], end)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _DECIDED, strict=True)], schema=_DECIDED)
        if rest := left():
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rest, strict=True), _DECIDED, strict=True)], schema=_DECIDED)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "group").sortWithinPartitions("group", "kind", "at", "place").drop("place")
    return dealt.mapInArrow(run, "kind int, id string, verdict string, who string, day int, n long, ends array<long>")


def decide(requests: DataFrame, state: DataFrame, day_most: int, open_most: int, zone: str = "UTC", ttl: int = 300) -> tuple[DataFrame, DataFrame]:
    """(verdicts, state) of requests that come after all that the state (STATE) has seen; verdicts as admit() gives them."""
    known = stored(_timed(requests, zone, ttl))
    asked, kept = _grouped(known, state, ttl)
    columns = [c.split(" ")[0] for c in _ROWS.split(", ")]
    before = kept.select("group", F.lit(0).cast("long").alias("at"), F.lit(LEFT).alias("kind"), F.lit(None).cast("string").alias("id"), "day", F.col("n").alias("end"), F.col("who").alias("ip"), F.lit(None).cast("string").alias("cookie"), F.array_join(F.transform("ends", lambda x: x.cast("string")), ",").alias("left"), F.lit(0).cast("long").alias("place"))
    # Ids order requests of one moment as they are, numbers as numbers; the fold itself takes them as text.
    now = asked.select("group", "at", F.lit(REQUEST).alias("kind"), F.col("id").cast("string").alias("id"), "day", "end", "ip", "cookie", F.lit(None).cast("string").alias("left"), F.col("id").alias("place"))
    rows = now.select(*columns, "place").unionByName(before.select(*columns, F.lit(None).cast(requests.schema["id"].dataType).alias("place")))
    out = stored(_folded(rows, day_most, open_most))
    found = known.join(out.where(f"kind = {REQUEST}").select(F.col("id").cast(requests.schema["id"].dataType).alias("id"), "verdict"), "id")
    retry = F.when(F.col("verdict") == "daily_limit", seconds_to_midnight(F.col("ts"), zone)).when(F.col("verdict") == "concurrency_limit", SOON)
    last = known.agg(F.max("at")).first()[0] or 0
    new = out.where(f"kind = {LEFT}").select("who", "day", "n", F.filter("ends", lambda e: e > last).alias("ends"), F.lit(last).alias("at"))
    # What is left of an identity: its last day, and what is open; older days count no more.
    both = state.select("who", "day", "n", F.filter("ends", lambda e: e > last).alias("ends"), "at").unionByName(new)
    after = both.groupBy("who").agg(F.max_by(F.struct("day", "n", "ends", "at"), F.struct("day", "at")).alias("x")).select("who", "x.*")
    return found.select("id", "verdict", retry.cast("long").alias("retry_after")), after


def admit(requests: DataFrame, day_most: int, open_most: int, zone: str = "UTC", ttl: int = 300) -> DataFrame:
    """(id, verdict, retry_after) of requests (id, ts, done, ip, cookie): admitted, daily_limit or concurrency_limit.

    In order of time, then id: refused if the address or the visitor has had day_most admitted on that local day, else if
    either has open_most open. One is open from its ts to `done`, at most ttl seconds; a refused one leaves no trace. A null address
    or cookie is an identity like any other; ids are unique.

    Each verdict rests on those before it of either identity, so requests are dealt out by groups whose verdicts can hang on each other,
    and decided in one pass over each. A group's rows stream through one task, as they wait for each other by definition.
    """
    return decide(requests, requests.sparkSession.createDataFrame([], STATE), day_most, open_most, zone, ttl)[0]


def admit_stream(requests: DataFrame, folder: str, day_most: int, open_most: int, zone: str = "UTC", ttl: int = 300) -> DataStreamWriter:
    """A stream of requests decided batch by batch; start it with a checkpoint. Verdicts go to folder/verdicts/batch=N, the state that a batch leaves to folder/state-N.

    A batch reads the state of the one before and writes its own under its number, so one that is done again after a failure
    gives the same rows over. A request that comes in a later batch than one of a later time is decided after it. Two identities are decided together, so no state
    keyed by one of them could hold this; the state has a row for each identity with its last day and what is open.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_or_empty(spark, f"{folder}/state-{number - 1}", STATE)
        verdicts, after = decide(batch, before, day_most, open_most, zone, ttl)
        after.write.mode("overwrite").parquet(f"{folder}/state-{number}")
        verdicts.write.mode("overwrite").parquet(f"{folder}/verdicts/batch={number}")

    return requests.writeStream.foreachBatch(one)
