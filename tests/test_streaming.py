"""Streams drained equal batches; late data, repeats and pending links."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rankforge.operators import ratings as G
from rankforge.sources import extract as E
from rankforge.sources import store
from rankforge.streaming import streams as ST
from tests.test_extract import CASES
from tests.test_ratings import COLUMNS, league


def files_in_order(spark, batches, schema, folder):
    """Each batch as one file, so that a stream takes them in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_tumbling_counts_and_late_rows(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "id long, ts timestamp, key string"
    batches = [[(1, day(1, 3), "a"), (2, day(1, 5), "a"), (3, day(2), "b")], [(4, day(2, 1), "b"), (5, day(5), "a")], [(8, day(5, 2), "c")], [(6, day(1, 1), "a")], [(7, day(20), "z")]]
    out = ST.drained(ST.tumbling_counts(files_in_order(spark, batches, schema, tmp_path / "in"), "ts", "key"))
    assert {(r["window_start"].day, r["key"], r["n"]) for r in out.collect()} == {(1, "a", 2), (2, "b", 2), (5, "a", 1), (5, "c", 1)}  # a batch drops what was late by the watermark of the one before


def test_dedup_counts_a_delivery_once(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3) for i in range(30)]
    s = files_in_order(spark, [rows[:20], rows[10:], rows[15:]], "id long, ts timestamp, v int", tmp_path / "in")
    assert ST.drained(ST.dedup(s, "ts", ["id"])).count() == 30


def test_parse_stream_equals_batch(spark, tmp_path):
    posts = [(i, html, "downloaded", None, dt.datetime(2024, 1, 1)) for i, (html, _) in CASES.items()]
    schema = "post_id long, raw_html string, status string, reason string, sort_time timestamp"
    s = files_in_order(spark, [posts[:5], posts[5:], posts[:3]], schema, tmp_path / "in")
    seen: dict[str, dict] = {}

    def sink(name, rows, batch):
        for r in rows.collect():
            key = (r["match_id"], r[1]) if name in ("match_maps", "match_vods") else r[0]
            seen.setdefault(name, {})[key] = tuple(r)

    ST.parse_stream(s, sink, str(tmp_path / "state")).awaitTermination()
    whole = spark.createDataFrame(posts, schema)
    assert set(seen["matches"].values()) == {tuple(r) for r in E.matches(whole).collect()}
    assert set(seen["match_maps"].values()) == {tuple(r) for r in E.match_maps(whole).collect()}
    assert {k: v[2:4] for k, v in seen["raw_posts"].items()} == {r["post_id"]: (r["status"], r["reason"]) for r in E.outcome(whole).collect()}


def test_silver_tables_are_the_same_after_a_replay(spark, tmp_path):
    posts = [(i, html, "downloaded", None, dt.datetime(2024, 1, 1)) for i, (html, _) in CASES.items()]
    schema = "post_id long, raw_html string, status string, reason string, sort_time timestamp"
    silver = ST.Silver(spark, str(tmp_path / "silver"), 3)
    for state, batches, again in (("a", [posts], False), ("b", [posts[:5], posts[5:]], True)):  # a new checkpoint makes the stream deliver its pages again
        silver.follow(files_in_order(spark, batches, schema, tmp_path / f"in-{state}"), "posts", str(tmp_path / state), again).awaitTermination()
    whole = spark.createDataFrame(posts, schema)
    rows = lambda df: sorted(map(str, df.collect()))
    for name, of in (("matches", E.matches), ("match_maps", E.match_maps), ("match_vods", E.match_vods), ("vod_embeds", E.vod_embeds)):
        assert rows(silver.read(name).select(*of(whole).columns)) == rows(of(whole)), name
    assert rows(silver.read("players").select("player_id", "name", "country")) == rows(E.dimension_players(E.matches(whole)))
    assert {r["tournament_id"]: r["name"] for r in silver.read("tournaments").collect()} == {6: "Cup & Co", 55: "Cup & Co"}
    assert silver.read("standings").count() == 3 and silver.read("raw_posts").count() == len(CASES) and silver.done("posts", 1) and not silver.done("posts", 9)


def test_rating_stream_repairs_late_matches(spark, tmp_path):
    rows = league(90)
    late = (900, 1, 2, 3, 0, 1, 1, "1v1", None, dt.datetime(2024, 1, 2))
    s = files_in_order(spark, [rows[:40], rows[40:70], [late, *rows[60:90]]], COLUMNS, tmp_path / "in")
    held = ST.Ratings(spark, str(tmp_path / "ratings"), unit="week")
    held.follow(s, str(tmp_path / "state")).awaitTermination()
    held.add(spark.createDataFrame([late, *rows[60:90]], COLUMNS), 2)  # the last batch once more
    want = {(r["player_id"], r["game_id"], r["match_id"]): r["rating"] for r in G.elo(spark.createDataFrame([*rows, late], COLUMNS)).collect()}
    got = {(r["player_id"], r["game_id"], r["match_id"]): r["rating"] for r in held.history().collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_records_are_in_order_across_batches(spark, tmp_path):
    """A key over several Arrow batches with rows interleaved, and over two micro-batches."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [(1 + i % 2, i, at(i * 37 % 101), "WLD"[i * i % 3]) for i in range(40)]
        s = files_in_order(spark, [rows[:25], rows[25:], [(9, 99, at(100_000), "W")]], "key long, id long, ts timestamp, result string", tmp_path / "in")
        got = {(r["key"], r["id"]): tuple(r)[2:7] for r in ST.drained(ST.running_records(s, "1 hour")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {}
    for key in (1, 2):
        m = w = lost = run = 0
        last = ""
        for k, i, _, r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            m, w, lost, run, last = m + 1, w + (r == "W"), lost + (r == "L"), run + 1 if r == last else 1, r
            want[k, i] = (m, w, lost, r, run)
    assert {k: v for k, v in got.items() if k[0] < 9} == want


def test_revisits_fire_once_unless_parsed_before(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    skip = lambda i, due, seen: (i, "skipped", "not played", day(due), day(seen))
    parsed = lambda i, seen: (i, "parsed", None, None, day(seen))
    batches = [[skip(1, 5, 1), skip(2, 6, 1), skip(3, 25, 1), skip(4, 5, 1)], [parsed(2, 3), skip(4, 9, 2)], [parsed(1, 8), skip(5, 12, 10)], [parsed(99, 20)]]
    s = files_in_order(spark, batches, "post_id long, status string, reason string, sort_time timestamp, seen timestamp", tmp_path / "in")
    assert sorted((r["post_id"], r["due"].day) for r in ST.drained(ST.revisits(s)).collect()) == [(1, 5), (4, 9), (5, 12)]


def test_embeds_wait_for_their_match(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    vods = files_in_order(spark, [[(1, at(1)), (2, at(2))], [(3, at(3))], [(99, at(28))]], "vod_post_id long, ts timestamp", tmp_path / "v")
    embeds = files_in_order(spark, [[(3, at(2), "c")], [(1, at(3), "a")], [(98, at(28), "z")]], "post_id long, seen timestamp, video_id string", tmp_path / "e")
    got = {r["vod_post_id"]: r["video_id"] for r in ST.drained(ST.link_embeds(vods, embeds)).collect()}
    assert {k: got.get(k, "?") for k in (1, 2, 3)} == {1: "a", 2: None, 3: "c"}


def test_due_posts(spark, tmp_path):
    rows = [(1, None, "skipped", "not played", dt.datetime(2024, 1, 1)), (2, None, "skipped", "not played", dt.datetime(2025, 1, 1)), (3, None, "parsed", None, dt.datetime(2023, 1, 1))]
    s = files_in_order(spark, [rows], "post_id long, raw_html string, status string, reason string, sort_time timestamp", tmp_path / "in")
    assert [r["post_id"] for r in ST.drained(ST.due_posts(s, "2024-06-01 00:00:00")).collect()] == [1]


def test_backup_restore_append_and_reset(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "match_id long, name string")
    posts = spark.createDataFrame([(1, "parsed", "r"), (2, "discovered", None)], "post_id long, status string, reason string")
    store.backup({"matches": a, "raw_posts": posts}, str(tmp_path))
    back = store.restore(spark, str(tmp_path), ["matches", "raw_posts"])
    assert sorted(map(tuple, back["matches"].collect())) == sorted(map(tuple, a.collect()))
    store.append(a, str(tmp_path), "matches")
    assert store.read(spark, str(tmp_path), "matches").count() == 4
    now = store.restore(spark, str(tmp_path), ["matches", "raw_posts"])  # back lists the files of its own time
    assert {r["name"]: r["n"] for r in store.reset(now, "parsed").collect()} == {"matches": 4}
    gone = store.reset({"matches": a, "raw_posts": posts}, "parsed", dry_run=False)
    assert gone["matches"].count() == 0 and {(r["post_id"], r["status"], r["reason"]) for r in gone["raw_posts"].collect()} == {(1, "downloaded", ""), (2, "discovered", None)}


def test_replaced_series_leave_others(spark, tmp_path):
    rows = lambda g, r: (1, g, "elo", 1, dt.datetime(2024, 1, 1), r, 0.0, 0.0, 1, 0, 1)
    store.replace_series(spark.createDataFrame([rows(0, 1500.0), rows(1, 1400.0)], G.HISTORY), str(tmp_path))
    store.replace_series(spark.createDataFrame([rows(1, 1450.0)], G.HISTORY), str(tmp_path))
    assert {(r["game_id"], r["rating"]) for r in store.read(spark, str(tmp_path), "rating_history").collect()} == {(0, 1500.0), (1, 1450.0)}


def test_smart_match_mode(spark):
    from rankforge.operators.relational import smart_match_mode, text_match

    names = spark.createDataFrame([("a_b",), ("axb",), ("Cy%",)], "name string")
    assert [smart_match_mode(names, "name", q) for q in ("^a", "axb", "a")] == ["regex", "exact", "partial"]
    found = lambda q, m: {r["name"] for r in names.filter(text_match("name", q, m)).collect()}
    assert found("A_", "partial") == {"a_b"} and found("y%", "partial") == {"Cy%"} and found("^A.B$", "regex") == {"a_b", "axb"}


def test_names_in_two_cases_resolve_to_the_exact_one(spark):
    from rankforge.operators.players import resolve

    players = spark.createDataFrame([(1, "Ann"), (2, "ann")], "player_id long, name string")
    aliases = spark.createDataFrame([(3, "BOB", 1), (4, "bob", 1)], "player_id long, name string, cnt long")
    queries = spark.createDataFrame([("Ann",), ("ann",), ("ANN",), ("bob",), ("Bob",), ("zed",)], "query string")
    assert {r["query"]: r["player_id"] for r in resolve(queries, players, aliases).collect()} == {"Ann": 1, "ann": 2, "ANN": 1, "bob": 4, "Bob": 3}


def test_a_partition_of_the_rating_stream_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ST.Ratings(spark, str(tmp_path), unit="year").add(spark.createDataFrame(league(60), COLUMNS), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lambda place: len([f for f in os.listdir(tmp_path / place) if f.endswith(".parquet")])
    assert files("matches/batch=0") > 1 and files("history/pool=0/period=2024") > 1
