"""Golden pages: one small page of each kind."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rankforge.operators import brackets as B
from rankforge.sources import extract as E
from rankforge.sources import providers as P


def player(i, name, flag):
    return f'<div class="m_name_flag"><div class="n"><a href="/player/{i}/{name.lower()}/20/game/"> {name}</a><i class="s_flag s_flag-{flag}"></i></div></div>'


def res(score, cls=""):
    return f'<div class="res"><div{f" class={chr(34)}{cls}{chr(34)}" if cls else ""}>{score}</div></div>'


def page(fmt="1v1 Duel", s1=res(2, "win"), s2=res(1, "loss"), icon='<i class="pfcat pfcat-20"></i>', extra=""):
    return (
        f'<title>A vs B</title><div class="match">{icon}{player(7, "Ann&amp;Co", "SE")}{s1}{player(8, "Bob", "us")}{s2}'
        f'<div class="title">Description</div><div>Quake Live<br/>{fmt}</div>'
        '<div class="title">Date</div><div class="date"><div>20:30 UTC</div><div>1st August 2026</div></div>'
        '<div class="title">Tournament</div><div><a href="/post/55/cup/">Cup &amp; Co</a><div>Final</div></div></div>'
        '<div class="match_vod"><i></i><a href="/post/900/a-vs-b/">VOD #1</a> - Caster</div>'
        f'</div><!--posthits=3-->{extra}'
    )


MAPS = (
    '<div class="m_detailed"><table><tr><td class="map"><span data-image="/files/images/maps/11_x.jpg" data-name="Blood">Blood</span></td><td class="mp_left">A</td><td class="score_value win">10</td><td class="score_value">-2</td><td class="mp_right">B</td></tr>'
    '<tr><td class="map" title="unknown map">?</td><td class="mp_left">A</td><td class="score_value">3</td><td class="score_value">5</td><td class="mp_right">B</td></tr></table></div> <script>'
)
TOURNAMENT = (
    '<h1 class="posttitle"><a href="/post/55/cup">Cup &amp; Co</a></h1><div id="postinnercontent"><div class="title"><i class="pfcat-20"></i> Premier Quake Live - Duel</div><div class="tour_info">'
    '<div class="tc_title">Prizemoney</div><div><b>100</b> USD</div><div class="tc_title">Schedule</div><div>09 Aug 2026 - 16:00 UTC → 20:15 UTC</div>'
    '<span class="map_preview" x="1" data-name="Awoken">Awoken</span><span class="map_preview" data-name="Blood">b</span>'
    '<table><tr><td class="position">1st</td><td><a class="profile" href="/player/7/ann">Ann</a></td><td class="prizemoney">60 USD</td></tr>'
    '<tr><td class="position">2nd</td><td><a class="profile" href="/player/8/bob"><span></span> Bob</a></td><td class="prizemoney"></td></tr></table>'
    '<div class="title"><i class="pfcat-3"></i> Major Other - Duel</div><table><tr><td class="position">1st</td><td><a class="profile" href="/player/9/cy">Cy</a></td><td class="prizemoney">5</td></tr></table></div>'
)
VOD = '<div class="postvods"><div class="videoplaceholder" data-type="YouTube" data-id="abc_1"></div></div>'
PARENT = '<div id="postinnercontent">' + '<div class="title"> <i class="pfcat-3"></i> <a href="/post/1/x">a</a></div>' * 2
CASES = {
    1: (page(extra=MAPS), "match"),
    2: (page(s1=res(0, "win"), s2=res(0)), "match"),
    3: (page(s1=res(-1), s2=res(-1), icon=""), "match"),
    4: (page(fmt="TDM 4v4"), "team format"),
    5: (page(s1="", s2=""), "not played"),
    6: (TOURNAMENT, "tournament"),
    7: (VOD, "vod"),
    8: (PARENT, "parent index"),
    9: ("<title>deleted | Site</title>", "invalid"),
    10: ("<title>news</title><p>hello</p>", "not a match"),
    11: ("", "invalid"),
    12: (None, "invalid"),
}


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([(i, html) for i, (html, _) in CASES.items()], "post_id long, raw_html string").cache()


def test_classes(posts):
    assert {r["post_id"]: r["k"] for r in posts.select("post_id", E.page_class(F.col("raw_html")).alias("k")).collect()} == {i: k for i, (_, k) in CASES.items()}


def test_matches(posts):
    rows = {r["match_id"]: r for r in E.matches(posts).collect()}
    m = rows[1]
    assert (m["player1_id"], m["player2_id"], m["player1_name"], m["player1_country"], m["player2_country"]) == (7, 8, "Ann&Co", "se", "us")
    assert (m["player1_score"], m["player2_score"], m["winner_id"], m["game_id"], m["game_name"], m["match_format"]) == (2, 1, 7, 20, "Quake Live", "1v1 Duel")
    assert (m["tournament_id"], m["tournament_name"], m["stage_name"], m["played_at"]) == (55, "Cup & Co", "Final", dt.datetime(2026, 8, 1, 20, 30))
    assert (rows[2]["player1_score"], rows[2]["player2_score"], rows[2]["winner_id"]) == (1, 0, 7)
    assert (rows[3]["player1_score"], rows[3]["winner_id"], rows[3]["game_id"]) == (-1, None, 20)


def test_maps_vods_embeds(posts):
    maps = [tuple(r) for r in E.match_maps(posts).orderBy("map_index").collect()]
    assert maps == [(1, 0, 11, "Blood", "/files/images/maps/11_x.jpg", 10, -2), (1, 1, None, "?", None, 3, 5)]
    vods = E.match_vods(posts).filter("match_id = 1").collect()
    assert [tuple(v) for v in vods] == [(1, 0, 900, "VOD #1", "Caster")]
    assert [tuple(r) for r in E.vod_embeds(posts).collect()] == [(7, "youtube", "abc_1")]


def test_rejected_pages_give_no_maps_or_vods(spark):
    df = spark.createDataFrame([(1, page(fmt="TDM 4v4", extra=MAPS)), (2, page(s1="", s2="", extra=MAPS))], "post_id long, raw_html string")
    assert E.match_maps(df).count() == 0 and E.match_vods(df).count() == 0


def test_entities_and_aliases(spark):
    import html

    from rankforge.functions import scalars as S

    texts = ["A&#38;B &#228; &eacute;", "&lt;b&gt; &amp;amp; &#x1F600; &#X41;", "&nosuch; & &;", "", None, "&#150;&#0;x&#55296;", "&apos;&quot;&#39;"]
    got = [r["u"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(S.unescape("x").alias("u")).collect()]
    want = [None if x is None else html.unescape(x) for x in texts]
    want[5] = "–&#0;x&#55296;"  # what is no character stays
    assert got == want
    names = spark.createDataFrame([(k, v) for k, v in S.GAME_ALIASES.items()] + [("My Game", "My Game"), (" QL ", "Quake Live")], "a string, g string")
    assert names.filter(S.resolve_game("a") != F.col("g")).count() == 0 and len(S.GAME_ALIASES) == 29


def test_tournaments_and_standings(spark, posts):
    games = spark.createDataFrame([(20, "Quake Live")], "game_id int, name string")
    t = E.tournaments(posts, games).collect()[0]
    assert (t["tournament_id"], t["name"], t["tier"], t["game"], t["game_id"], t["prize_money"], t["maplist"]) == (6, "Cup & Co", "premier", "Quake Live", 20, "100 USD", ["Awoken", "Blood"])
    assert (t["schedule_start"], t["schedule_end"]) == (dt.datetime(2026, 8, 9, 16), dt.datetime(2026, 8, 9, 20, 15))
    rows = [(r["position"], r["player_id"], r["player_name"], r["prize"], r["game_category_id"]) for r in E.standings(posts.filter("post_id = 6")).orderBy("block_no", "row_no").collect()]
    assert rows == [("1st", 7, "Ann", "60 USD", 20), ("2nd", 8, "Bob", "", 20), ("1st", 9, "Cy", "5", 3)]


def test_listing(spark):
    html = '<a href="/post/11/a-vs-b/" class="listmatch " x><i title="02 Aug 2026 17:45 UTC"></i></a><a href="/post/12/c/" class="listmatch " x><i title="03 Aug 2026 18:00 UTC"></i></a><a href="?page=2">next page</a>'
    df = spark.createDataFrame([(1, html)], "page int, html string")
    assert [(r["match_id"], r["played_at"]) for r in E.listed_matches(df).orderBy("match_id").collect()] == [(11, dt.datetime(2026, 8, 2, 17, 45)), (12, dt.datetime(2026, 8, 3, 18, 0))]
    assert df.select(E.has_next(F.col("html"))).first()[0]


def test_bracket_sources(spark):
    uuid = "0" * 8 + "-1111-2222-3333-" + "4" * 12
    pages = {"https://play.toornament.com/en_US/tournaments/123/x": ("toornament", "123"), "http://shambler.site/a/brackets.php?cup=9": ("shambler", "9"), "https://egb.com/cup#/t/some-slug/bracket": ("egb", "some-slug"), f"https://kuachi.gg/cups/{uuid}/stage/1": ("kuachi", f"{uuid}/stage/1"), "nothing": (None, None)}
    df = spark.createDataFrame([(k,) for k in pages], "h string")
    kind, ref = E.bracket_source(F.col("h"))
    assert {r["h"]: (r["k"], r["r"]) for r in df.select("h", kind.alias("k"), ref.alias("r")).collect()} == pages


PAYLOADS = [
    (1, "toornament", {"stages": [{"id": "s", "name": "Main", "closed": True}], "matches": [{"stage": {"id": "s"}, "group": {"id": "2", "name": "Losers"}, "round": {"number": 1, "name": "LB 1"}, "opponents": [{"participant": {"name": "A"}, "score": 2, "result": "win"}, None]}, {"stage": {"id": "s"}, "group": {"id": "1", "name": "Winners"}, "round": {"number": 1, "name": "WB 1"}, "opponents": [{"participant": {"name": "A"}, "score": 0, "result": "loss"}, {"participant": {"name": "B"}, "score": 1, "result": "win"}]}]}),
    (2, "shambler", {"title": "Cup", "status": 2, "players": [{"id": "1", "discord_name": "A"}, {"id": "2", "discord_name": "B"}], "brackets": [{"id": "wb", "matches": [{"round": 0, "num": 1, "players": ["1", "2"], "scores": [1, 3]}]}]}),
    (3, "egb", {"name": "Cup", "participants": [{"id": "x", "displayName": "A"}, {"id": "y", "displayName": "B"}], "matches": [{"side": "WINNERS", "round": 1, "indexInRound": 0, "status": "LIVE", "winner": "x", "home": {"type": "player", "participant": "x"}, "away": {"type": "player", "participant": "y"}, "score": {"home": 2, "away": 0}}]}),
    (4, "kuachi", {"title": "Stage 1", "stage_id": "s", "matches": [{"id": "m", "cup_stage_id": "s", "low_id": "l", "high_id": "h", "elim_type": "GF", "elim_round": 0, "is_scored": True, "winner_id": "h", "low_report": [{"low": 3, "high": 5}, {"low": 9, "high": 1}, {"low": 0, "high": 2}]}, {"id": "n", "cup_stage_id": "s", "low_id": "l", "is_scored": True}, {"id": "o", "cup_stage_id": "t", "low_id": "l", "high_id": "h"}], "signups": [{"id": "l", "player_id": "1"}, {"id": "h", "player_id": "2"}], "profiles": [{"id": "1", "discord_username": "A"}, {"id": "2", "discord_username": "B"}]}),
]


def test_providers(spark):
    df = spark.createDataFrame([(i, k, json.dumps(p)) for i, k, p in PAYLOADS], "tournament_id long, kind string, payload string")
    rows = {(r["tournament_id"], r["group"]): (r["group_no"], r["round_no"], r["p1"], r["p2"], r["score1"], r["score2"], r["winner"]) for r in P.normalize(df).collect()}
    assert rows == {(1, "Winners"): (0, 1, "A", "B", 0, 1, "p2"), (1, "Losers"): (1, 1, "A", "", 2, None, "p1"), (2, "Winners Bracket"): (0, 0, "A", "B", 1, 3, "p2"), (3, "Winners Bracket"): (0, 1, "A", "B", 2, 0, "p1"), (4, "Grand Final"): (0, 0, "A", "B", 1, 2, "p2")}
    assert {r["tournament_id"]: r["complete"] for r in P.provider_complete(df).collect()} == {1: True, 2: True, 3: False, 4: True}


def test_native_bracket(spark):
    cell = lambda n, s, w=False: f'<div class="bracket-cell-r1"><div class="bracket-name"{" style=" + chr(34) + "font-weight:700" + chr(34) if w else ""}>{n}</div><div class="bracket-score">{s}</div></div>'
    html = f'<div class="bracket"><div class="bracket-column"><div class="bracket-round-title">Round 1</div><div class="bracket-match">{cell("A", 2, True)}{cell("B", 0)}</div></div><div class="bracket-column"><div class="x"></div></div><div class="bracket-column"><div class="bracket-round-title">Grand Final</div><div class="bracket-match">{cell("A", "-")}{cell("C", 3, True)}</div></div></div>'
    rows = P.native(spark.createDataFrame([(1, html), (2, None)], "tournament_id long, html string")).orderBy("group_no").collect()
    assert [(r["group"], r["round"], r["p1"], r["p2"], r["score1"], r["score2"], r["winner"]) for r in rows] == [("Winners Bracket", "Round 1", "A", "B", 2, 0, "p1"), ("Grand Final", "Grand Final", "A", "C", None, 3, "p2")]


def test_bracket_operators(spark):
    columns = "tournament_id long, stage_no int, stage string, group_no int, group string, round_no int, round string, match_no int, p1 string, p2 string, score1 int, score2 int, winner string"
    rows = [
        (1, 0, "", 0, "Winners Bracket", 0, "", 0, "A", "B", 1, 0, None),
        (1, 0, "", 0, "Winners Bracket", 0, "", 1, "C", "D", 0, 1, "p2"),
        (1, 0, "", 0, "Winners Bracket", 1, "", 0, "A", "D", 2, 0, "p1"),
        (1, 0, "", 1, "Losers Bracket", 0, "", 0, "B", "C", 1, 0, "p1"),
        (1, 0, "", 2, "Grand Final", 0, "", 0, "A", "B", 3, 0, "p1"),
        (1, 0, "", 1, "Losers Bracket", 0, "", 1, "", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, columns)
    kept = B.drop_empty(df)
    assert kept.count() == 5
    merged = B.merge_final(kept)
    final = merged.filter("p1 = 'A' and p2 = 'B' and score1 = 3").first()
    assert (final["group_no"], final["round_no"]) == (0, 2)
    won = B.infer_winners(merged)
    assert won.filter("round_no = 0 and match_no = 0 and group_no = 0").first()["winner"] == "p1"
    names = {(r["group_no"], r["round_no"]): r["round"] for r in B.rename_rounds(won).collect()}
    assert names == {(0, 0): "WB Quarter-final", (0, 1): "WB Semi-final", (0, 2): "WB Final", (1, 0): "LB Final"}
    edges = {(r["from_round"], r["from_match"], r["to_round"], r["to_match"]) for r in B.advancement(won).filter("group_no = 0").collect()}
    assert edges == {(0, 0, 1, 0), (0, 1, 1, 0), (1, 0, 2, 0)}
    assert B.completeness(won).first()["complete"]


def test_flatten(spark):
    data = {"stages": [{"name": "S", "groups": [{"name": "G", "rounds": [{"name": "R", "round": 1, "matches": [{"p1": "A", "p2": "B", "score1": 1, "score2": 0, "winner": "p1"}]}]}]}]}
    df = spark.createDataFrame([(1, json.dumps(data)), (2, '{"stages": []}'), (3, None)], "tournament_id long, data string")
    assert [(r["group"], r["round"], r["p1"], r["winner"]) for r in B.flatten(df).collect()] == [("G", "R", "A", "p1")]
    assert {r["tournament_id"]: r["has_bracket"] for r in B.has_bracket(df).collect()} == {1: True, 2: False, 3: False}


def test_register_and_walls(spark):
    posts = spark.createDataFrame([(i, "skipped", "invalid") for i in [1, 2, 3, 5, 99_999, 100_000, 100_001, 100_002]], "post_id long, status string, reason string")
    assert {(r["first_id"], r["last_id"], r["length"]) for r in E.walls(posts, 3).collect()} == {(1, 3, 3), (99_999, 100_002, 4)}


def test_dates(spark):
    from rankforge.functions import scalars as S

    df = spark.createDataFrame([("3rd May 2024", "07:05 UTC", "bad", "09 Aug 2026 - 16:00 UTC → 20:15 UTC", "2024-05-03T07:05:00Z")], "d string, t string, l string, s string, i string")
    r = df.select(S.parse_ordinal_date("d", "t").alias("a"), S.parse_list_date("l").alias("b"), *[x.alias(n) for x, n in zip(S.parse_schedule("s"), "cd")], S.parse_iso("i").alias("e")).first()
    assert tuple(r) == (dt.datetime(2024, 5, 3, 7, 5), dt.datetime(2000, 1, 1), dt.datetime(2026, 8, 9, 16), dt.datetime(2026, 8, 9, 20, 15), dt.datetime(2024, 5, 3, 7, 5))
