"""Steps whose work must not pile up in one task or be done over again as tables grow."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rankforge.functions import scalars as S
from rankforge.plans import pages as P
from rankforge.plans import queries as Q
from rankforge.sources import extract as E
from rankforge.sources import providers as PV
from rankforge.sources import store
from rankforge.streaming import streams as ST
from rankforge.tables import Tables

DIR = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("read", [E.matches, E.match_maps, E.match_vods, lambda p: E.tournaments(p, p.sparkSession.createDataFrame([], "game_id int, name string"))])
def test_a_page_is_written_once(spark, read):
    pages = spark.range(3).select(F.col("id").alias("post_id"), F.concat(F.lit("<p>once</p>"), F.col("id").cast("string")).alias("raw_html"))
    assert optimized(read(pages)).count("<p>once</p>") == 1


def test_the_match_area_ends_at_the_first_mark(spark):
    pages = [f'x{E.MATCH}a{E.MATCH_ENDS[0]}b{E.MATCH_ENDS[1]}c', f'x{E.MATCH}a{E.MATCH_ENDS[1]}b{E.MATCH_ENDS[0]}c', f'x{E.MATCH}abc', f'{E.MATCH_ENDS[0]}abc', f'{E.MATCH}{E.MATCH_ENDS[1]}']
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").select("i", E.content(F.col("p")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["a", "a", None, None, ""]


def test_tournament_pages_are_dealt_to_all_tasks(spark):
    assert P.tournament_pages(Tables(spark, DIR)).rdd.getNumPartitions() == 4


def test_volatilities_are_worked_out_by_arrays(spark):
    df = spark.createDataFrame([(1.0, 0.06, 0.5, 0.9), (None, 0.06, 0.5, 0.9)], "phi double, vol double, v double, delta double")
    df = df.withColumn("new", S.glicko_volatility("phi", "vol", "v", "delta"))
    assert "aggregate(" not in optimized(df)
    assert [r["new"] is None for r in df.collect()] == [False, True]


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    silver = ST.Silver(spark, str(tmp_path), 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables are joined to one file
    try:
        for _ in range(2):
            silver.upsert("t", spark.range(400).withColumnRenamed("id", "post_id"), ["post_id"], lambda both: both.distinct())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("t/_bucket=0/*.parquet"))) > 1
    assert sorted(r["post_id"] for r in silver.table("t").collect()) == list(range(400))


def test_pages_of_a_batch_are_not_held_in_memory(spark, tmp_path):
    """Nor are their files kept when the batch has ended."""
    spark.range(40).selectExpr("id as post_id", "concat('<title>', repeat('x', 5000), id, '</title>') as raw_html").write.parquet(str(tmp_path / "in"))
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before, seen, folders = held(), {}, []

    def sink(name, rows, batch):
        seen[name] = rows.count()
        assert held() <= before
        folders.extend(f for f in rows.inputFiles() if f not in folders)

    ST.parse_stream(spark.readStream.schema("post_id long, raw_html string").parquet(str(tmp_path / "in")), sink, str(tmp_path / "state")).awaitTermination()
    assert seen["raw_posts"] == 40 and len(seen) == len(ST.SETS) + len(ST.DIMENSIONS) + 1
    assert folders and not [f for f in folders if os.path.exists(f.removeprefix("file://"))]


def test_a_page_keeps_its_last_batch_by_one_shuffle(spark, tmp_path):
    rows = [(1, "a", 0), (1, "b", 0), (1, "a", 0), (2, "c", 0), (1, "d", 1), (1, "d", 1), (1, "e", 1), (3, None, 2), (3, None, 2), (2, "c", 0)]
    dealt = spark.createDataFrame(rows, "post_id long, raw_html string, _batch long").withColumns({"_bucket": F.col("post_id") % 2, "_share": F.col("post_id") % 3}).repartition("_bucket", "_share")
    out = ST.newest(dealt, ["post_id"])
    assert sorted((r["post_id"], str(r["raw_html"])) for r in out.collect()) == [(1, "d"), (1, "e"), (2, "c"), (3, "None")]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hash") == 1


@pytest.mark.parametrize("name", ["t9_rating_deltas", "t12_standings"])
def test_rating_changes_take_more_tasks_as_matches_grow(spark, monkeypatch, name):
    """1500 matches; a task gets 100 of them, and the session has its settings again."""
    conf, seen, inner = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"), [], store.stored
    monkeypatch.setattr(store, "stored", lambda df: seen.append([spark.conf.get(c) for c in conf]) or inner(df))
    own = [spark.conf.get(c) for c in conf]
    plain = sorted(map(repr, Q.QUERIES[name](spark, DIR).collect()))
    monkeypatch.setattr(store, "ROWS", 100)
    assert sorted(map(repr, Q.QUERIES[name](spark, DIR).collect())) == plain
    assert seen == [own, ["15", f"{store.BYTES}b", f"{store.BYTES}b"]]
    assert [spark.conf.get(c) for c in conf] == own


class Held:
    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_visits_of_a_post_set_one_timer(spark):
    visit = lambda seen, due: Row(status="skipped" if due else "parsed", reason="not played" if due else None, sort_ms=due, seen_ms=seen)
    held, post = Held(), ST.Revisit()
    post.init(held)
    assert list(post.handleInputRows((1,), iter([visit(3, 20), visit(1, 10), visit(2, 30)]), None)) == []
    assert (held.value, held.timers, held.calls) == ((20,), {20}, 1)
    assert list(post.handleInputRows((1,), iter([visit(4, None)]), None)) == [] and held.timers == set() and held.value is None


CELLS = ['<div class="bracket-column"><div class="bracket-round-title">Round 1</div><div class="bracket-match">', '<div class="bracket-cell-r1"><div class="bracket-name" style="font-weight: 700">a b</div><div class="bracket-score">2</div></div>', '<div class="bracket-cell-r2"><div class="bracket-name">c</div><div class="bracket-score">x</div></div>', "</div></div>"]


@pytest.mark.parametrize("odd", ["", "<br>", "<br/>", "a < b", "x &amp; y", "<!-- <div> -->", "<script>if (a<b) '<div>'</script>", "<DIV class='bracket-name'>z</DIV>", "<title>t</title>", "tail", "</p>", '<i class="">k</i>', "\n"])
@pytest.mark.parametrize("place", range(5))
def test_plain_brackets_are_read_as_by_the_parser(monkeypatch, odd, place):
    html = "".join([*CELLS[:place], odd, *CELLS[place:]])
    want = PV._Rounds()
    want.feed(html)
    assert PV._Rounds().read(html) == want.columns
    if not odd:
        monkeypatch.setattr(PV._Rounds, "feed", None)
        assert PV._Rounds().read(html)[0]["matches"][0][0] == {"name": "a b", "score": "2", "won": True}
