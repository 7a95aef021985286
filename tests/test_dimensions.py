"""Dimensions told piece by piece, map lists and images, flags of standings: nulls, ties, repeats, no rows."""

import random

from pyspark.sql import functions as F

from rankforge.operators import relational as R
from rankforge.operators import tournaments as T
from rankforge.sources import extract as E


def test_latest_columns_in_any_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.randrange(6), rng.randrange(3)) for _ in range(80)]
    df = lambda part: spark.createDataFrame(part, "k int, x string, y int, t int, m int").withColumn("at", F.struct("t", "m"))
    want = {}
    for k, x, y, t, m in rows:
        own = want.setdefault(k, {})
        for c, v in (("x", x), ("y", y)):
            if v is not None and (c not in own or (t, m, v) > own[c]):
                own[c] = (t, m, v)
    want = {(k, own.get("x", (0, 0, None))[2], own.get("y", (0, 0, None))[2]) for k, own in want.items()}
    once = lambda part: E.latest_columns(df(part), ["k"], ["x", "y"])
    found = lambda d: {(r["k"], r["x"], r["y"]) for r in d.collect()}
    assert found(once(rows)) == want
    both = E.latest_columns(once(rows[40:]).unionByName(once(rows[:50])), ["k"], ["x", "y"])
    assert found(both) == want and found(E.latest_columns(both.unionByName(both), ["k"], ["x", "y"])) == want
    assert once([]).count() == 0


def test_tournament_pages_stand_over_match_pages(spark):
    matches = spark.createDataFrame([(1, 5, "Old", "2024-05-01 00:00:00"), (2, 5, "", "2024-06-01 00:00:00"), (3, 6, "Six", None), (4, None, "none", "2024-01-01 00:00:00")], "match_id long, tournament_id long, tournament_name string, played_at string").withColumn("played_at", F.col("played_at").cast("timestamp"))
    page = '<h1 class="posttitle"><a href="/post/5/c">Own &amp; name</a></h1><div id="postinnercontent"><div class="title"><i class="pfcat-2"></i> Major Game - Duel</div><div class="tour_info"></div></div>'
    own = E.tournaments(spark.createDataFrame([(5, page)], "post_id long, raw_html string"), spark.createDataFrame([], "game_id int, name string"))
    got = {r["tournament_id"]: (r["name"], r["tier"]) for r in E.latest_columns(E.tournament_facts(matches, own), ["tournament_id"], E.TOURNAMENT_COLUMNS).collect()}
    assert got == {5: ("Own & name", "major"), 6: ("Six", None)}


def test_maps_of_a_tournament(spark):
    listed = spark.createDataFrame([(1, 0, 7, "Seven", "/maps/7_a.jpg"), (1, 1, 3, "Three", "/maps/3_a.jpg"), (1, 2, 7, "Again", "/maps/7_b.jpg"), (2, 0, 9, "Nine", None)], "tournament_id long, place int, map_id int, name string, image string")
    played = spark.createDataFrame([(1, 3, 2), (1, 5, 1), (1, 4, 1), (3, 8, 1)], "tournament_id long, map_id int, times long")
    maps = spark.createDataFrame([(3, "three", "own.jpg"), (4, "Four", None), (8, None, "eight.jpg")], "map_id int, name string, image string")
    got = sorted(tuple(r) for r in T.tournament_maps(listed, played, maps).collect())
    assert got == [(1, 1, 7, "Seven", "/maps/7_a.jpg"), (1, 2, 3, "Three", "own.jpg"), (1, 3, 4, "Four", None), (1, 4, 5, "Unknown", None), (2, 1, 9, "Nine", None), (3, 1, 8, "Unknown", "eight.jpg")]
    assert T.tournament_maps(listed.limit(0), played.limit(0), maps).count() == 0
    named = spark.createDataFrame([(1, "x", None), (2, "x", "b"), (5, "x", "a"), (6, "y", "")], "map_id int, name string, image string")
    asked = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "name string")
    assert {r["name"]: r["image"] for r in T.map_images(asked, named, "name").collect()} == {"x": "b", "y": "", "z": "", None: ""}
    assert {r["map_id"]: r["image"] for r in T.map_images(named.select("map_id"), named).collect()} == {1: "", 2: "b", 5: "a", 6: ""}


def test_standings_flags(spark):
    seats = '[{"position":"1st","player_id":1,"player_name":"A"},{"position":"2nd","player_id":2,"player_name":""},{"position":"3rd","player_id":3,"player_name":"C"}]'
    events = spark.createDataFrame([(1, 4, seats), (2, 4, '[{"position":"1st","player_id":1,"player_name":"A"}]'), (3, None, None)], "tournament_id long, game_id int, rankings string")
    players = spark.createDataFrame([(1, "se"), (2, None)], "player_id long, country string")
    stats = spark.createDataFrame([(1, 1, 2, 0, None, None, None, None), (1, 2, 0, 2, 0, 0, 0, 0)], "tournament_id long, player_id long, wins long, losses long, map_wins long, map_losses long, frags long, deaths long")
    deltas = spark.createDataFrame([(1, 1, "elo", 8.0), (1, 1, "glicko2", 20.0), (1, 2, "elo", -8.0)], "tournament_id long, player_id long, rating_system string, delta double")
    out = T.enriched_standings(events, players, stats, deltas, spark.createDataFrame([(1,), (2,), (1,)], "player_id long"))
    got = {(r["tournament_id"], r["player_id"]): r for r in out.collect()}
    assert len(got) == 4 and [got[1, p]["unknown"] for p in (1, 2, 3)] == [False, False, True]
    assert [(got[1, p]["elo_delta"], got[1, p]["glicko2_delta"]) for p in (1, 2, 3)] == [(8.0, 20.0), (None, None), (None, None)]
    assert [got[1, 1][c] for c in ("has_matches", "has_maps", "has_frags")] == [True, False, False]
    assert [got[2, 1][c] for c in ("wins", "has_matches", "has_maps")] == [None, False, False]


def test_match_modes(spark):
    names = spark.createDataFrame([("Ann",), ("b.c",), (None,)], "name string")
    asked = spark.createDataFrame([(1, "Ann"), (2, "ann"), (3, "b.c"), (4, "a|b"), (5, "x\\y"), (6, None), (7, "Ann")], "i int, q string")
    got = {r["i"]: r["mode"] for r in R.match_modes(asked, names).collect()}
    assert got == {1: "exact", 2: "partial", 3: "exact", 4: "regex", 5: "regex", 6: "partial", 7: "exact"}
