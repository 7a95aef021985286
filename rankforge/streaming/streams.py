"""Structured Streaming forms of the continuous jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankforge.functions import scalars as S
from rankforge.functions.scalars import base_k
from rankforge.operators import ratings as G
from rankforge.sources import extract
from rankforge.sources.store import LONG_VALUES, SHARES, discard, shared_folder, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 1) -> DataFrame:
    """A given table as a stream of its files; the brackets let one file count as a folder of one."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with an event time that watermarks accept."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads back what it wrote to the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{place}-state").trigger(availableNow=True).start(f"{place}-rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}-rows")


def tumbling_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows per window and key; a window comes out once the watermark has passed it."""
    w = F.window(F.col(time), width)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def dedup(stream: DataFrame, time: str, keys: list[str], delay: str = "2 days") -> DataFrame:
    """Rows delivered again within the watermark's delay are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class Record(StatefulProcessor):
    """Running matches, wins, losses and streak of a key, one row an input row in order of time.

    Rows are held until the watermark has passed them, so that rows of later batches which are earlier in time
    still come before; a timer at the earliest held row lets them out.
    """

    SCHEMA = "key long, id long, matches long, wins long, losses long, result string, length long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("record", "matches long, wins long, losses long, result string, length long")
        self.held = handle.getListState("held", "ms long, id long, result string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            ms = (f["ts"].to_numpy().astype("datetime64[us]").astype("int64") // 1000).tolist()
            self.held.appendList(list(zip(ms, f["id"].tolist(), f["result"].tolist())))
            first = min([*ms, *([first] if first is not None else [])])
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame(columns=[c.split(" ")[0] for c in self.SCHEMA.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, rows = timerValues.getCurrentWatermarkInMs(), sorted(self.held.get())
        late = [tuple(r) for r in rows if r[0] > now]
        m, w, lost, last, run = self.state.get() if self.state.exists() else (0, 0, 0, "", 0)
        out = []
        for _, i, r in rows[: len(rows) - len(late)]:
            m, w, lost = m + 1, w + (r == "W"), lost + (r == "L")
            run = run + 1 if r == last else 1
            last = r
            out.append((key[0], i, m, w, lost, last, run))
        if out:
            self.state.update((m, w, lost, last, run))
        if late:
            self.held.put(late)
            self.handle.registerTimer(late[0][0])
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in self.SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def running_records(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """stream has key, id, ts and result (W, L or D), at most delay late; K follows from the matches so far."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = stream.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(statefulProcessor=Record(), outputStructType=Record.SCHEMA, outputMode="Append", timeMode="EventTime")
    return out.withColumn("k", base_k("matches"))


class Revisit(StatefulProcessor):
    """A post that was not played yet is due again at its scheduled time, unless it is parsed before; times in ms."""

    SCHEMA = "post_id long, due long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = before = self.due.get()[0] if self.due.exists() else None
        for r in sorted(rows, key=lambda r: r["seen_ms"]):
            if held is not None and r["seen_ms"] < held:  # rescheduled or parsed in time: the old timer is void
                held = None
            if held is None and r["status"] == "skipped" and r["reason"] == "not played":
                held = r["sort_ms"]
        if held != before:
            if before is not None:
                self.handle.deleteTimer(before)
                self.due.clear()
            if held is not None:
                self.due.update((held,))
                self.handle.registerTimer(held)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        yield Row(post_id=key[0], due=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def revisits(posts: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(post_id, due) once the watermark of seen, the time of each visit, has passed a post's scheduled time.

    posts: post_id, status, reason, sort_time (when it is scheduled) and seen. A visit before that time voids or
    moves it. One timer a post, by event time, so that a drained stream gives what a live one gave.
    """
    posts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream = posts.withWatermark("seen", delay).select("post_id", "status", "reason", F.unix_millis(F.coalesce("sort_time", "seen")).alias("sort_ms"), F.unix_millis("seen").alias("seen_ms"), "seen")
    out = stream.groupBy("post_id").transformWithState(statefulProcessor=Revisit(), outputStructType=Revisit.SCHEMA, outputMode="Append", timeMode="EventTime")
    return out.select("post_id", F.timestamp_millis("due").alias("due"))


def link_embeds(vods: DataFrame, embeds: DataFrame, delay: str = "3 days") -> DataFrame:
    """Vods with the embed of their page, which may come before or after; without one in time, null."""
    v = vods.withWatermark("ts", delay).alias("v")
    e = embeds.withWatermark("seen", delay).alias("e")
    near = F.expr("v.vod_post_id = e.post_id and e.seen >= v.ts - interval 3 days and e.seen <= v.ts + interval 3 days")
    return v.join(e, near, "leftOuter").select("v.vod_post_id", "v.ts", "e.video_id")


#: Tables that a page gives whole: what is read, and the columns that name the page.
SETS: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "raw_posts": (lambda p: extract.outcome(p), ["post_id"]),
    "matches": (lambda p: extract.matches(p), ["match_id"]),
    "match_maps": (lambda p: extract.match_maps(p), ["match_id"]),
    "match_vods": (lambda p: extract.match_vods(p), ["match_id"]),
    "vod_embeds": (lambda p: extract.vod_embeds(p), ["vod_post_id"]),
    "standings": (lambda p: extract.standings(p.filter(extract.kind_of(p) == "tournament")), ["tournament_id"]),
}
#: Dimensions that pages tell of piece by piece.
DIMENSIONS = {"players": (["player_id"], ["name", "country"]), "games": (["game_id"], ["name"]), "maps": (["map_id"], ["name", "image"]), "tournaments": (["tournament_id"], extract.TOURNAMENT_COLUMNS)}


def parse_stream(posts: DataFrame, sink: Callable[[str, DataFrame, int], None], checkpoint: str, skipped: Callable[[int], bool] = lambda batch: False):
    """Parses each micro-batch of pages into tables; sink(name, rows, batch) must be keyed, so that a batch that
    runs again changes nothing. Dimension rows carry a version of each column; aliases are rows a match.

    Pages and what is read from them are kept as files, not in executors' memory, and go when the batch has ended; a
    sink may read its rows several times. Batches that are skipped are not parsed. Files are read row by row, in the stream's own session: some thousand pages
    at once are much where pages are long."""

    def batch(df: DataFrame, number: int) -> None:
        if skipped(number):
            return
        df.sparkSession.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
        kept = []

        def keep(rows: DataFrame) -> DataFrame:
            kept.append(stored(rows, LONG_VALUES))
            return kept[-1]

        try:
            pages = keep(extract.classified(df))
            read = {name: of(pages) if name == "raw_posts" else keep(of(pages)) for name, (of, _) in SETS.items()}
            for name, rows in read.items():
                sink(name, rows, number)
            matches = read["matches"]
            own = keep(extract.tournaments(pages, matches.select("game_id", F.col("game_name").alias("name")).limit(0)))
            facts = {"players": extract.player_facts(matches), "games": extract.game_facts(matches), "maps": extract.map_facts(read["match_maps"], matches), "tournaments": extract.tournament_facts(matches, own)}
            for name, rows in facts.items():
                sink(name, keep(extract.latest_columns(rows, *DIMENSIONS[name])), number)
            sink("aliases", extract.player_facts(matches).select(F.col("at.match_id").alias("match_id"), "player_id", "name"), number)
        finally:
            discard(*kept)

    return posts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each page's last _batch, equal ones once: told by a hash, so that pages are neither sorted by nor grouped by their text.

    rows are dealt by _bucket and _share and so stay where they are, and come out in order of _bucket.
    """
    page = Window.partitionBy("_bucket", "_share", *keys).orderBy(F.desc("_batch"), "_row")
    marked = rows.withColumn("_row", F.xxhash64(*rows.columns)).withColumns({"_last": F.first("_batch").over(page), "_before": F.lag("_row").over(page)})
    return marked.filter("_batch = _last and (_before is null or _before <> _row)").drop("_row", "_last", "_before")


class Silver:
    """Keyed tables that a stream writes: each in buckets by a hash of its key, of which a batch rewrites those it touches,
    by at least SHARES tasks each.

    A table of SETS or aliases keeps the rows of a page's last batch; a dimension keeps the last value of each column. Both
    are the same however often and in whatever order batches come, and a ledger skips batches that are complete.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def table(self, name: str, spark: SparkSession | None = None) -> DataFrame | None:
        try:
            return (spark or self.spark).read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None  # nothing was written yet

    def read(self, name: str) -> DataFrame:
        return self.table(name).drop("_bucket", "_batch")

    def upsert(self, name: str, rows: DataFrame, keys: list[str], merged: Callable[[DataFrame], DataFrame]) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in rows.select(bucket.alias("_bucket")).distinct().collect()]  # at most buckets
        if not touched:
            return
        held = self.table(name, rows.sparkSession)
        both = rows if held is None else held.filter(F.col("_bucket").isin(touched)).drop("_bucket").unionByName(rows)
        shares = max(SHARES, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        share = F.pmod(F.shiftrightunsigned(F.xxhash64(*keys), 16), F.lit(shares))
        out = merged(both.withColumns({"_bucket": bucket, "_share": share}).repartition("_bucket", "_share")).drop("_share")
        out = out if "_bucket" in out.columns else out.withColumn("_bucket", bucket)
        kept = None if held is None else stored(out, LONG_VALUES)  # read whole before its place is overwritten
        (out if kept is None else kept).write.mode("overwrite").options(**LONG_VALUES).option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        if kept is not None:
            discard(kept)

    def sink(self, name: str, rows: DataFrame, batch: int) -> None:
        if name in DIMENSIONS:
            keys, columns = DIMENSIONS[name]
            self.upsert(name, rows, keys, lambda both: extract.latest_columns(both, keys, columns))
        else:
            keys = SETS[name][1] if name in SETS else ["match_id"]
            self.upsert(name, rows.withColumn("_batch", F.lit(batch).cast("long")), keys, lambda both: newest(both, keys))

    def done(self, stream: str, batch: int) -> bool:
        ledger = self.table("batches")
        return ledger is not None and ledger.filter((F.col("stream") == stream) & (F.col("batch") == batch)).limit(1).count() > 0

    def follow(self, posts: DataFrame, stream: str, checkpoint: str, again: bool = False):
        """Parses a stream of pages into the tables. again: batches in the ledger run once more."""
        names = [*SETS, *DIMENSIONS, "aliases"]

        def sink(name: str, rows: DataFrame, batch: int) -> None:
            self.sink(name, rows, batch)
            if name == names[-1]:
                mark = self.spark.createDataFrame([(stream, batch)], "stream string, batch long")
                self.upsert("batches", mark, ["stream", "batch"], lambda both: both.distinct())

        return parse_stream(posts, sink, checkpoint, lambda batch: not again and self.done(stream, batch))


class Ratings:
    """An Elo history that a stream of matches keeps up to date, with the state of every pool after each period.

    A batch rates anew from the first period that it touches in a pool, from the states before it; pools and
    earlier periods stay as they are, so that on-time matches cost their own period and a late match the periods
    since. Tables are partitioned by pool and period, and a batch overwrites the partitions that it rates.
    """

    def __init__(self, spark: SparkSession, folder: str, tournaments: DataFrame | None = None, unit: str = "month"):
        self.spark, self.folder, self.tournaments, self.unit = spark, folder, tournaments, unit

    def table(self, name: str, like: DataFrame | None = None) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None if like is None else like.limit(0)

    def history(self) -> DataFrame:
        return self.table("history").withColumnRenamed("pool", "game_id").drop("period")

    def put(self, name: str, rows: DataFrame, by: list[str], share: str = "match_id") -> None:
        """Overwrites the partitions that rows has, each by SHARES tasks."""
        rows.repartition(*by, F.pmod(F.xxhash64(share), F.lit(SHARES))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{name}")

    def add(self, matches: DataFrame, batch: int) -> None:
        """Takes a batch of matches; those that are known are left out, and a batch may run again."""
        known = self.table("matches", matches.withColumn("batch", F.lit(batch)))
        new = matches.dropDuplicates(["match_id"]).join(known.filter(F.col("batch") != batch).select("match_id"), "match_id", "left_anti")
        self.put("matches", stored(new.withColumn("batch", F.lit(batch))), ["batch"])
        rows = G.rating_input(self.table("matches").drop("batch"), self.tournaments).withColumn("period", S.period_key("played_at", self.unit))
        touched = G.rating_input(new, self.tournaments).withColumn("period", S.period_key("played_at", self.unit))
        since = stored(touched.groupBy("pool").agg(F.min("period").alias("since")))
        if not since.limit(1).count():
            return
        own = stored(rows.join(since, "pool").filter("period >= since").drop("since"))
        before = self.table("states")
        state = None
        if before is not None:
            last = F.max_by(F.struct("rating", "wins", "losses", "matches_played"), "period")
            state = stored(before.join(since, "pool").filter("period < since").groupBy("pool", "player_id").agg(last.alias("s")).select("pool", "player_id", "s.*"))
        rated = G.elo_of(own.drop("period"), state).withColumnRenamed("game_id", "pool").withColumn("period", S.period_key("played_at", self.unit))
        rated = stored(rated)
        self.put("history", rated, ["pool", "period"])
        last = F.max_by(F.struct("rating", "wins", "losses", "matches_played"), F.struct("played_at", "match_id"))
        self.put("states", rated.groupBy("pool", "period", "player_id").agg(last.alias("s")).select("pool", "period", "player_id", "s.*"), ["pool", "period"], "player_id")

    def follow(self, matches: DataFrame, checkpoint: str):
        return matches.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_posts(stream: DataFrame, now: str) -> DataFrame:
    """Posts of a stream that are due again: their scheduled time has come."""
    return extract.due(stream, F.lit(now).cast("timestamp"))
