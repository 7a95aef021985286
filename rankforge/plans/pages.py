"""Queries over pages, brackets, stores and streams that are built from the given tables.

The given pages hold none of the site's kinds, so pages are written from the match data model, and what is read
back from them must equal the rows that they were written from.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions import scalars as S
from rankforge.operators import brackets as B
from rankforge.operators import ratings as G
from rankforge.operators import relational as R
from rankforge.operators import tournaments as T
from rankforge.plans.queries import CANON, DUEL, ORACLES, PAIR, at, num, query, ts
from rankforge.sources import extract as E
from rankforge.sources import providers as PV
from rankforge.sources import store
from rankforge.streaming import streams as ST
from rankforge.tables import with_views

#: Every so many posts hold pages of other kinds, by the remainder of the post's number.
KINDS = 29


def text(*parts) -> Column:
    """The parts joined; plain strings are taken as they are and nulls as nothing."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def escaped(name: str):
    return F.replace(F.replace(F.col(name), F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;"))


def ordinal(col: str):
    day = F.dayofmonth(col)
    suffix = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return text(day, suffix, " ", F.date_format(col, "MMMM yyyy"))


def match_pages(t) -> DataFrame:
    """(post_id, raw_html): a page a match with its maps and recordings, and every KINDS posts one of each other kind."""
    maps = t.match_maps.withColumn("name", F.when(F.col("map_id") % 5 > 0, text("map ", F.col("map_id"))))
    image = F.when(F.col("map_id").isNotNull(), text('<span data-image="/files/images/maps/', F.col("map_id"), '_x.jpg"', F.when(F.col("name").isNotNull(), text(' data-name="', F.col("name"), '"')), ">m</span>"))
    row = text('<tr><td class="map">', F.coalesce(image, F.lit("?")), '</td><td class="score_value win">', F.col("player1_score"), '</td><td class="score_value">', F.col("player2_score"), "</td></tr>")
    maps = maps.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("map_index", row.alias("row")))).alias("m")).select("match_id", F.array_join(F.col("m.row"), "").alias("maps"))
    link = text('<div class="match_vod"><i></i><a href="/post/', F.col("vod_post_id"), '/v/">VOD #', F.col("vod_index"), "</a> - Caster ", F.col("vod_post_id") % 7, "</div>")
    vods = t.match_vods.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("vod_index", link.alias("row")))).alias("v")).select("match_id", F.array_join(F.col("v.row"), "").alias("vods"))
    rows = R.with_names(t.matches, t.players).join(t.games.withColumnRenamed("name", "game"), "game_id", "left").join(maps, "match_id", "left").join(vods, "match_id", "left")
    player = lambda k: text('<div class="m_name_flag"><div class="n"><a href="/player/', F.col(f"player{k}_id"), "/p/", F.col("game_id"), '/x/"> ', escaped(f"player{k}"), "</a>", F.when(F.col(f"player{k}_country").isNotNull(), text('<i class="s_flag s_flag-', F.upper(f"player{k}_country"), '"></i>')), "</div></div>")
    cell = lambda k: text('<div class="res"><div', F.when(F.col("winner_id") == F.col(f"player{k}_id"), ' class="win"').when(F.col("winner_id").isNotNull(), ' class="loss"'), ">", F.col(f"player{k}_score"), "</div></div>")
    kind = F.col("match_id") % KINDS
    score = lambda k: F.when(kind == 1, "").otherwise(cell(k))
    cup = F.when(F.col("tournament_id").isNotNull(), text('<div class="title">Tournament</div><div><a href="/post/', F.col("tournament_id"), '/c/">Cup &amp; ', F.col("tournament_id"), "</a><div>", F.col("stage_name"), "</div></div></div>"))
    page = text(
        '<title>A vs B</title><div class="match"><i class="pfcat pfcat-', F.col("game_id"), '"></i>', player(1), score(1), player(2), score(2),
        '<div class="title">Description</div><div>', F.col("game"), "<br/>", F.col("match_format"), '</div><div class="title">Date</div><div class="date"><div>',
        F.date_format("played_at", "HH:mm"), " UTC</div><div>", ordinal("played_at"), "</div></div>", cup, F.col("vods"), "</div><!--posthits=3-->",
        '<div class="m_detailed"><table>', F.col("maps"), "</table></div> <script>",
    )
    other = (
        F.when(kind == 0, "<title>deleted | site</title>")
        .when(kind == 2, '<div class="postvods"></div>')
        .when(kind == 3, "<title>news</title>")
        .when(kind == 5, '<div id="postinnercontent">' + '<div class="title"> <i class="pfcat-3"></i> <a href="/post/1/x">a</a></div>' * 2)
        .when(kind == 6, '<div id="postinnercontent"><div class="tour_info"></div></div>')
    )
    return rows.select(F.col("match_id").alias("post_id"), F.when(kind != 4, F.coalesce(other, page)).alias("raw_html"))


LIVE = f"(select * from matches where match_id % {KINDS} not in (0, 1, 2, 3, 4, 5, 6) and {DUEL})"
query("e1_page_classes", f"""select match_id as post_id, case match_id % {KINDS} when 0 then 'invalid' when 2 then 'vod' when 3 then 'not a match' when 4 then 'invalid' when 5 then 'parent index' when 6 then 'tournament'
 when 1 then case when lower(match_format) like '%duel%' or lower(match_format) like '%1v1%' then 'not played' else 'team format' end
 else case when {DUEL} then 'match' when lower(match_format) like '%duel%' then 'parse error' else 'team format' end end as kind from matches""")(
    lambda t: match_pages(t).select("post_id", E.page_class(F.col("raw_html")).alias("kind"))
)
WON = "coalesce(winner_id, case when player1_score > player2_score then player1_id when player2_score > player1_score then player2_id end)"
query("e2_e3_e4_match_pages", f"""select match_id, player1_id, player2_id, a.name as player1_name, b.name as player2_name, player1_country, player2_country, {WON} as winner_id,
 case when player1_score = player2_score and winner_id is not null then cast(winner_id = player1_id as int) else player1_score end as player1_score,
 case when player1_score = player2_score and winner_id is not null then cast(winner_id = player2_id as int) else player2_score end as player2_score,
 game_id, g.name as game_name, match_format, tournament_id, case when tournament_id is not null then 'Cup & ' || tournament_id end as tournament_name,
 case when tournament_id is not null then stage_name end as stage_name, {ts('played_at')}
 from {LIVE} m left join players a on a.player_id = player1_id left join players b on b.player_id = player2_id left join games g using (game_id)""")(
    lambda t: E.matches(match_pages(t)).select("match_id", "player1_id", "player2_id", "player1_name", "player2_name", "player1_country", "player2_country", "winner_id", "player1_score", "player2_score", "game_id", "game_name", "match_format", "tournament_id", "tournament_name", "stage_name", at("played_at"))
)
query("e6_match_maps", f"select match_id, cast(row_number() over (partition by match_id order by map_index) - 1 as int) as map_index, map_id, case when map_id % 5 > 0 then 'map ' || map_id else '?' end as map_name, mm.player1_score, mm.player2_score from match_maps mm join (select match_id from {LIVE} l) k using (match_id)")(
    lambda t: E.match_maps(match_pages(t)).select("match_id", F.col("map_index").cast("int"), "map_id", "map_name", "player1_score", "player2_score")
)
query("e7_match_vods", f"select match_id, vod_index, vod_post_id, 'VOD #' || vod_index as label, 'Caster ' || (vod_post_id % 7) as caster from match_vods join (select match_id from {LIVE} l) k using (match_id)")(
    lambda t: E.match_vods(match_pages(t))
)


def vod_pages(t) -> DataFrame:
    """A page a recording, with its embed where it has one."""
    embed = text('<div class="postvods"><div class="videoplaceholder big" data-type="', F.initcap("platform"), '" data-id=" ', F.col("video_id"), '"></div></div>')
    return t.match_vods.groupBy("vod_post_id").agg(F.max("platform").alias("platform"), F.max("video_id").alias("video_id")).select(F.col("vod_post_id").alias("post_id"), F.coalesce(F.when(F.col("platform").isNotNull(), embed), F.lit("<p>none</p>")).alias("raw_html"))


query("e8_vod_embeds", "select vod_post_id, max(platform) as platform, max(video_id) as video_id from match_vods group by 1 having max(platform) is not null")(lambda t: E.vod_embeds(vod_pages(t)))


def tournament_pages(t) -> DataFrame:
    """A page a tournament with its tier, game, prize, schedule, maps and ranking."""
    tier = F.when(F.col("tier").isNotNull(), text(F.initcap("tier"), " "))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("tournament_id") % 700).cast("int"))
    maps = F.array_join(F.transform(F.split("maplist_csv", ","), lambda m: F.concat(F.lit('<span class="map_preview" x="1" data-name="'), m, F.lit('">m</span>'))), "")
    seats = F.from_json("rankings", "array<struct<position:string,player_id:bigint,player_name:string>>")
    row = lambda r: F.concat(F.lit('<tr><td class="position">'), r["position"], F.lit('</td><td><a class="profile" href="/player/'), r["player_id"].cast("string"), F.lit('/p"><span></span> n'), r["player_name"], F.lit('</a></td><td class="prizemoney">'), r["player_id"].cast("string"), F.lit(" USD</td></tr>"))
    page = text(
        '<h1 class="posttitle"><a href="/post/', F.col("tournament_id"), '/c">', F.replace("name", F.lit("&"), F.lit("&amp;")), ' &eacute;</a></h1><div id="postinnercontent"><div class="title"><i class="pfcat-', F.col("game_id"), '"></i> ', tier, "Game ", F.col("game_id"),
        ' - Duel</div><div class="tour_info"><div class="tc_title">Prizemoney</div><div><b>', F.col("tournament_id") * 10, '</b> USD</div><div class="tc_title">Schedule</div><div>', F.date_format(day, "dd MMM yyyy"), " - 16:00 UTC → 20:15 UTC</div>",
        maps, "<table>", F.array_join(F.transform(seats, row), ""), "</table></div>",
    )
    return G.spread(t.tournaments, "tournament_id").select(F.col("tournament_id").alias("post_id"), page.alias("raw_html"))


query("e10_e11_tournament_pages", "select tournament_id, name || ' é' as name, coalesce(tier, 'minor') as tier, 'Game ' || game_id as game, game_id, (tournament_id * 10) || ' USD' as prize_money, strftime(date '2024-01-01' + cast(tournament_id % 700 as int) + interval 16 hour, '%Y-%m-%d %H:%M:%S') as schedule_start, strftime(date '2024-01-01' + cast(tournament_id % 700 as int) + interval 1215 minute, '%Y-%m-%d %H:%M:%S') as schedule_end, maplist_csv as maplist from tournaments")(
    lambda t: E.tournaments(tournament_pages(t), t.games).select("tournament_id", "name", "tier", "game", "game_id", "prize_money", at("schedule_start"), at("schedule_end"), F.array_join("maplist", ",").alias("maplist"))
)
query("e12_standings", """select tournament_id, cast(i as int) as row_no, rankings::json->(i::int)->>'position' as position, cast(rankings::json->(i::int)->>'player_id' as bigint) as player_id, 'n' || (rankings::json->(i::int)->>'player_name') as player_name, (rankings::json->(i::int)->>'player_id') || ' USD' as prize, game_id as game_category_id
 from tournaments cross join (select unnest([0, 1]) as i) x""")(
    lambda t: E.standings(tournament_pages(t)).select("tournament_id", F.col("row_no").cast("int"), "position", "player_id", "player_name", "prize", "game_category_id")
)


def listing_pages(t) -> DataFrame:
    """Listing pages of a hundred matches each; all but the last have a link to the next."""
    link = text('<a href="/post/', F.col("match_id"), '/a-vs-b/" class="listmatch " x><i title="', F.date_format("played_at", "dd MMM yyyy HH:mm"), ' UTC"></i></a>')
    rows = t.matches.select(F.expr("match_id div 100").alias("page"), "match_id", link.alias("link"))
    last = rows.agg(F.max("page").alias("last"))
    pages = rows.groupBy("page").agg(F.array_join(F.sort_array(F.collect_list("link")), "").alias("html")).crossJoin(F.broadcast(last))  # one row
    return pages.select("page", F.when(F.col("page") < F.col("last"), text(F.col("html"), '<a href="?page=', F.col("page") + 1, '">next page</a>')).otherwise(F.col("html")).alias("html"))


query("e13_match_list", f"select match_id // 100 as page, match_id, {ts('played_at')}, match_id // 100 < (select max(match_id // 100) from matches) as has_next from matches")(
    lambda t: E.listed_matches(listing_pages(t)).join(listing_pages(t).select("page", E.has_next(F.col("html")).alias("has_next")), "page").select("page", "match_id", at("played_at"), "has_next")
)
query("e15_caught_up", "select page, new, known, coalesce(max(case when full_run = 3 then 1 else 0 end) over (order by page rows between unbounded preceding and current row) = 1, false) as caught_up from (select page, new, known, sum(case when new = 0 then 1 else 0 end) over (order by page rows between 2 preceding and current row) as full_run from (select match_id // 100 as page, count(*) filter (where not known) as new, count(*) filter (where known) as known from (select match_id, match_id % 1000 >= 400 as known from matches) a group by 1) b) c")(
    lambda t: E.progress(t.matches.select(F.expr("match_id div 100").alias("page"), "match_id"), t.matches.filter("match_id % 1000 >= 400").select(F.col("match_id").alias("post_id")))
)
query("e19_bracket_sources", """select tournament_id, case tournament_id % 5 when 0 then 'toornament' when 1 then 'shambler' when 2 then 'egb' when 3 then 'kuachi' end as kind,
 case tournament_id % 5 when 0 then cast(tournament_id as varchar) when 1 then cast(tournament_id as varchar) when 2 then 'cup-' || tournament_id when 3 then '00000000-1111-2222-3333-444444444444/stage/' || tournament_id end as ref from tournaments""")(
    lambda t: t.tournaments.select("tournament_id", F.concat(F.lit('<a href="https://'), F.element_at(F.array(text("play.toornament.com/en_US/tournaments/", F.col("tournament_id")), text("shambler.site/a/brackets.php?cup=", F.col("tournament_id")), text("egb.com/cup#/t/cup-", F.col("tournament_id")), text("kuachi.gg/cups/00000000-1111-2222-3333-444444444444/stage/", F.col("tournament_id")), text("example.org/", F.col("tournament_id"))), (F.col("tournament_id") % 5 + 1).cast("int")), F.lit('">')).alias("h")).select("tournament_id", *[x.alias(n) for x, n in zip(E.bracket_source(F.col("h")), ("kind", "ref"))])
)

# --- dimensions, told piece by piece, the later pages first ---------------------------------------


def in_two_turns(facts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The dimension after the facts of every other version, then all of them, have been merged."""
    facts = store.stored(facts)
    some = E.latest_columns(facts.filter(F.crc32(F.to_json("at")) % 2 == 0), keys, columns)
    return E.latest_columns(some.unionByName(E.latest_columns(facts, keys, columns)), keys, columns)


query("e23_games_upsert", "select game_id, max_by(name, (played_at, match_id)) as name from (select game_id, played_at, match_id, 'Game ' || game_id || ' ' || (match_id % 11) as name from matches where match_id % 4 > 0) m group by 1")(
    lambda t: in_two_turns(E.game_facts(t.matches.withColumn("game_name", F.when(F.col("match_id") % 4 > 0, text("Game ", F.col("game_id"), " ", F.col("match_id") % 11)).otherwise(""))), ["game_id"], ["name"]).select("game_id", "name")
)
query("e23_maps_upsert", """select map_id, max_by(name, (played_at, match_id, name)) as name, max_by(image, (played_at, match_id, image)) filter (where image is not null) as image
 from (select map_id, played_at, match_id, 'map ' || map_id || ' ' || (match_id % 7) as name, case when match_id % 5 = 0 then '/maps/' || map_id || '_' || (match_id % 3) end as image from match_maps join matches using (match_id) where map_id > 0 and match_id % 6 > 0) m group by 1""")(
    lambda t: in_two_turns(E.map_facts(t.match_maps.select("match_id", "map_id", F.when(F.col("match_id") % 6 > 0, text("map ", F.col("map_id"), " ", F.col("match_id") % 7)).otherwise("?").alias("map_name"), F.when(F.col("match_id") % 5 == 0, text("/maps/", F.col("map_id"), "_", F.col("match_id") % 3)).alias("image")), t.matches), ["map_id"], ["name", "image"]).select("map_id", "name", "image")
)
query("e23_tournaments_upsert", """select tournament_id, coalesce(p.name, m.name) as name, p.tier, p.game_id, p.maplist from (select tournament_id, max_by(name, (played_at, match_id)) filter (where name is not null) as name
  from (select tournament_id, played_at, match_id, case when match_id % 5 > 0 then 'Cup ' || stage_name end as name from matches where tournament_id is not null) a group by 1) m
 full join (select tournament_id, name || ' é' as name, coalesce(tier, 'minor') as tier, game_id, maplist_csv as maplist from tournaments where tournament_id % 3 = 0) p using (tournament_id)""")(
    lambda t: in_two_turns(
        E.tournament_facts(t.matches.withColumn("tournament_name", F.when(F.col("match_id") % 5 > 0, text("Cup ", F.col("stage_name"))).otherwise("")), E.tournaments(tournament_pages(t).filter("post_id % 3 = 0"), t.games)), ["tournament_id"], E.TOURNAMENT_COLUMNS
    ).select("tournament_id", "name", "tier", "game_id", F.array_join("maplist", ",").alias("maplist"))
)


def maplist_pages(t) -> DataFrame:
    """Tournament pages that list three maps, one of them twice on some pages; every fourth lists none."""
    number = lambda k: F.pmod(F.col("tournament_id") * k, F.lit(70)) + 1
    shown = lambda k: text('<span class="map_preview" data-image="/files/images/maps/', number(k), '_p.jpg" data-name="M ', number(k), '">m</span>\n')
    return t.tournaments.select(F.col("tournament_id").alias("post_id"), F.when(F.col("tournament_id") % 4 > 0, F.concat(shown(7), shown(3), shown(1))).otherwise("<p>none</p>").alias("raw_html"))


def pictured(t) -> DataFrame:
    return t.maps.withColumn("image", F.when(F.col("map_id") % 3 > 0, text("img/", F.col("map_id"))))


query("t10_tournament_maps", """with page as (select tournament_id, map_id, min(i) as seat from (select tournament_id, i, (tournament_id * k) % 70 + 1 as map_id from tournaments cross join (values (0, 7), (1, 3), (2, 1)) v(i, k) where tournament_id % 4 > 0) x group by 1, 2),
 played as (select distinct m.tournament_id, mm.map_id from matches m join match_maps mm using (match_id) where m.tournament_id is not null and mm.map_id is not null),
 listed as (select tournament_id, map_id, seat from page full join played using (tournament_id, map_id))
 select tournament_id, cast(row_number() over (partition by tournament_id order by seat nulls last, b.map_id) as int) as place, b.map_id, case when seat is not null then 'M ' || b.map_id else coalesce(x.name, 'Unknown') end as name,
  case when x.map_id is not null and x.map_id % 3 > 0 then 'img/' || x.map_id when seat is not null then '/files/images/maps/' || b.map_id || '_p.jpg' end as image from listed b left join maps x on x.map_id = b.map_id""")(
    lambda t: T.tournament_maps(E.listed_maps(maplist_pages(t)), T.played_maps(t.matches, t.match_maps, t.maps), pictured(t)).select("tournament_id", "place", F.col("map_id").cast("bigint").alias("map_id"), "name", "image")
)
query("x2_images_by_id", "select distinct mm.map_id, case when x.map_id is not null and x.map_id % 3 > 0 then 'img/' || x.map_id else '' end as image from match_maps mm left join maps x using (map_id) where mm.map_id is not null")(
    lambda t: T.map_images(t.match_maps.filter("map_id is not null").select("map_id").distinct(), pictured(t)).select("map_id", "image")
)
query("x2_images_by_name", "select 'map' || p.player_id as name, coalesce('img/' || min(x.map_id), '') as image from players p left join maps x on x.name = 'map' || p.player_id and x.map_id % 3 > 0 group by 1")(
    lambda t: T.map_images(t.players.select(text("map", F.col("player_id")).alias("name")), pictured(t), "name").select("name", "image")
)
query("f22_map_display", "select match_id, map_index, case when map_id is null then 'Unknown' when map_id % 5 = 0 then 'Unknown' else 'map' || map_id end as name from match_maps")(
    lambda t: t.match_maps.select("match_id", "map_index", S.map_display(F.when(F.col("map_id") % 5 == 0, "?").otherwise(F.when(F.col("map_id").isNotNull(), text("map", F.col("map_id"))))).alias("name"))
)

# --- brackets -------------------------------------------------------------------------------------


def bracket(t) -> DataFrame:
    """A bracket a tournament: its matches in rounds of four by id, every fifth tournament with a losers' group."""
    rows = t.matches.filter("tournament_id is not null").withColumn("i", F.expr("row_number() over (partition by tournament_id order by match_id) - 1"))
    name = lambda k: F.when(F.col("match_id") % 9 == 0, "").otherwise(text("p", F.col(f"player{k}_id") % 6))
    group = F.when((F.col("tournament_id") % 5 == 0) & (F.col("i") % 2 == 1), 1).otherwise(0)
    return rows.select("tournament_id", F.lit(0).alias("stage_no"), F.lit("").alias("stage"), group.alias("group_no"), F.when(group == 1, "Losers Bracket").otherwise("Winners Bracket").alias("group"), F.expr("cast(i div 4 as int)").alias("round_no"), F.lit("R").alias("round"), F.expr("cast(i % 4 as int)").alias("match_no"), name(1).alias("p1"), name(2).alias("p2"), F.col("player1_score").alias("score1"), F.col("player2_score").alias("score2"), F.when(F.col("match_id") % 4 > 0, F.when(F.col("player1_score") >= F.col("player2_score"), "p1").otherwise("p2")).alias("winner"))


LONG = """(select tournament_id, case when tournament_id % 5 = 0 and i % 2 = 1 then 1 else 0 end as group_no, cast(i // 4 as int) as round_no, cast(i % 4 as int) as match_no,
 case when match_id % 9 = 0 then '' else 'p' || (player1_id % 6) end as p1, case when match_id % 9 = 0 then '' else 'p' || (player2_id % 6) end as p2, player1_score as score1, player2_score as score2,
 case when match_id % 4 > 0 then case when player1_score >= player2_score then 'p1' else 'p2' end end as winner
 from (select *, row_number() over (partition by tournament_id order by match_id) - 1 as i from matches where tournament_id is not null) m)"""
KEY = ["tournament_id", "group_no", "round_no", "match_no"]
query("b1_drop_empty", f"select tournament_id, group_no, round_no, match_no, p1, p2 from {LONG} l where p1 <> '' or p2 <> ''")(lambda t: B.drop_empty(bracket(t)).select(*KEY, "p1", "p2"))
query("b2_merge_final", f"select tournament_id, case when fin then 0 else group_no end as group_no, case when fin then round_no + up + 1 else round_no end as round_no, match_no from (select *, tournament_id % 5 = 0 and group_no = 1 as fin, max(case when group_no = 0 then round_no end) over (partition by tournament_id) as up from {LONG} l) x")(
    lambda t: B.merge_final(bracket(t).withColumn("group", F.when(F.col("group_no") == 1, "Grand Final").otherwise(F.col("group")))).select(*KEY)
)
query("b3_rename_rounds", f"""select tournament_id, group_no, round_no, match_no, (case when group_no = 1 then 'LB ' else 'WB ' end) || case when away = 0 then 'Final' when away = 1 then 'Semi-final' when away = 2 then 'Quarter-final' when away <= 6 then 'Round of ' || cast(pow(2, away + 1) as int) else 'R' end as round
 from (select *, max(round_no) over (partition by tournament_id, group_no) - round_no as away from {LONG} l) x""")(lambda t: B.rename_rounds(bracket(t)).select(*KEY, "round"))
AHEAD = f"exists (select 1 from {LONG} n where n.tournament_id = l.tournament_id and n.group_no = l.group_no and n.round_no = l.round_no + 1 and l.{{0}} <> '' and l.{{0}} in (n.p1, n.p2))"
INFERRED = f"(select *, coalesce(winner, case when one and not two then 'p1' when two and not one then 'p2' end) as won from (select l.*, {AHEAD.format('p1')} as one, {AHEAD.format('p2')} as two from {LONG} l) x)"
query("b4_infer_winners", f"select tournament_id, group_no, round_no, match_no, won as winner from {INFERRED} y")(lambda t: B.infer_winners(bracket(t)).select(*KEY, "winner"))
query("b5_advancement", f"""select f.tournament_id, f.group_no, f.round_no as from_round, f.match_no as from_match, n.round_no as to_round, min(n.match_no) as to_match
 from (select *, case winner when 'p1' then p1 when 'p2' then p2 end as name from {LONG} l) f join {LONG} n on n.tournament_id = f.tournament_id and n.group_no = f.group_no and n.round_no = f.round_no + 1 and f.name in (n.p1, n.p2) where f.name <> '' group by 1, 2, 3, 4, 5""")(
    lambda t: B.advancement(bracket(t)).select("tournament_id", "group_no", "from_round", "from_match", "to_round", "to_match")
)
query("b6_completeness", f"select tournament_id, bool_and(winner is not null) as complete from {LONG} l group by 1")(lambda t: B.completeness(bracket(t)))


def stored_brackets(t) -> DataFrame:
    """Normalised bracket JSON a tournament; every fourth has no stage, every seventh is null."""
    match = F.struct("p1", "p2", "score1", "score2", "winner")
    rounds = bracket(t).groupBy("tournament_id", "round_no").agg(F.array_sort(F.collect_list(F.struct(F.struct("group_no", "match_no").alias("k"), match.alias("m")))).alias("m"))
    each = rounds.select("tournament_id", F.struct("round_no", F.struct(F.lit("R").alias("name"), F.col("round_no").alias("round"), F.col("m.m").alias("matches")).alias("r")).alias("r")).groupBy("tournament_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    stage = F.array(F.struct(F.lit("S").alias("name"), F.array(F.struct(F.lit("G").alias("name"), F.col("r.r").alias("rounds"))).alias("groups")))
    data = F.when(F.col("tournament_id") % 7 == 0, None).when(F.col("tournament_id") % 4 == 0, '{"stages": []}').otherwise(F.to_json(F.struct(stage.alias("stages"))))
    return each.select("tournament_id", data.alias("data"))


query("m6_bracket_flags", f"select distinct tournament_id, tournament_id % 7 <> 0 and tournament_id % 4 <> 0 as has_bracket from {LONG} l")(lambda t: B.has_bracket(stored_brackets(t)))
query("b_flatten", f"select tournament_id, round_no, p1, p2, score1, score2, winner from {LONG} l where tournament_id % 7 <> 0 and tournament_id % 4 <> 0")(
    lambda t: B.flatten(stored_brackets(t)).select("tournament_id", "round_no", "p1", "p2", "score1", "score2", "winner")
)


def shambler(t) -> DataFrame:
    """Provider payloads of one bracket each, as one of the four providers sends them."""
    seats = lambda k: F.when(F.col(f"p{k}") == "", None).otherwise(F.col(f"p{k}"))
    rows = bracket(t).filter("group_no = 0 and p1 <> '' and p2 <> '' and p1 <> p2")
    match = F.struct(F.col("round_no").alias("round"), F.col("match_no").alias("num"), F.array(seats(1), seats(2)).alias("players"), F.array("score1", "score2").alias("scores"))
    players = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("id"), F.concat(F.lit("name"), i.cast("string")).alias("discord_name")))
    payload = F.to_json(F.struct(F.lit("Cup").alias("title"), F.lit(2).alias("status"), players.alias("players"), F.array(F.struct(F.lit("wb").alias("id"), F.array_sort(F.collect_list(match)).alias("matches"))).alias("brackets")))
    return rows.groupBy("tournament_id").agg(payload.alias("payload")).select("tournament_id", F.lit("shambler").alias("kind"), "payload")


query("e20_provider_brackets", f"select tournament_id, round_no, 'name' || substr(p1, 2) as p1, 'name' || substr(p2, 2) as p2, score1, score2 from {LONG} l where group_no = 0 and p1 <> '' and p2 <> '' and p1 <> p2")(
    lambda t: PV.normalize(shambler(t)).select("tournament_id", "round_no", "p1", "p2", "score1", "score2")
)

PLAYED = "group_no = 0 and p1 <> '' and p2 <> '' and p1 <> p2"


def payloads(t, match: Column, whole, kind: str) -> DataFrame:
    """A payload a tournament: whole(its matches in order) as JSON."""
    rows = bracket(t).filter(PLAYED)
    return rows.groupBy("tournament_id").agg(F.to_json(whole(F.array_sort(F.collect_list(match)))).alias("payload")).select("tournament_id", F.lit(kind).alias("kind"), "payload")


def numbered(kind) -> Column:
    """Participants p0 to p5 by id."""
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: kind(F.concat(F.lit("p"), i.cast("string")), F.concat(F.lit("name"), i.cast("string"))))


def toornament(t) -> DataFrame:
    seat = lambda k: F.struct(F.struct(F.concat(F.lit("name"), F.substring(f"p{k}", 2, 9)).alias("name")).alias("participant"), F.col(f"score{k}").alias("score"), F.when(F.col("winner") == f"p{k}", "win").otherwise("loss").alias("result"))
    match = F.struct("round_no", "match_no", F.struct(F.lit("s1").alias("id")).alias("stage"), F.struct(F.lit("g").alias("id"), F.lit("Winners").alias("name")).alias("group"), F.struct(F.col("round_no").alias("number"), F.col("round").alias("name")).alias("round"), F.array(seat(1), seat(2)).alias("opponents"))
    stage = F.array(F.struct(F.lit("s1").alias("id"), F.lit("Main").alias("name"), F.lit(True).alias("closed")))
    return payloads(t, match, lambda m: F.struct(stage.alias("stages"), m.alias("matches")), "toornament")


def egb(t) -> DataFrame:
    seat = lambda k: F.struct(F.lit("player").alias("type"), F.col(f"p{k}").alias("participant")).alias("home" if k == 1 else "away")
    won = F.when(F.col("winner") == "p1", F.col("p1")).when(F.col("winner") == "p2", F.col("p2")).alias("winner")
    match = F.struct(F.col("round_no").alias("round"), F.col("match_no").alias("indexInRound"), F.lit("WINNERS").alias("side"), seat(1), seat(2), F.struct(F.col("score1").alias("home"), F.col("score2").alias("away")).alias("score"), won)
    people = numbered(lambda i, n: F.struct(i.alias("id"), n.alias("displayName")))
    return payloads(t, match, lambda m: F.struct(F.lit("Cup").alias("name"), people.alias("participants"), m.alias("matches")), "egb")


def kuachi(t) -> DataFrame:
    """Scores are maps won, so a report has a map for each point."""
    maps = lambda score, low, high: F.when(F.col(score) > 0, F.array_repeat(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")), F.col(score))).otherwise(F.array().cast("array<struct<low:int,high:int>>"))
    won = F.when(F.col("winner") == "p1", F.col("p1")).when(F.col("winner") == "p2", F.col("p2")).alias("winner_id")
    match = F.struct(F.col("round_no").alias("elim_round"), F.col("match_no").alias("elim_index"), F.lit("WB").alias("elim_type"), F.lit("s").alias("cup_stage_id"), F.col("p1").alias("low_id"), F.col("p2").alias("high_id"), F.concat(maps("score1", 9, 2), maps("score2", 3, 7)).alias("low_report"), won)
    return payloads(t, match, lambda m: F.struct(F.lit("Cup").alias("title"), F.lit("s").alias("stage_id"), numbered(lambda i, n: F.struct(i.alias("id"), i.alias("player_id"))).alias("signups"), numbered(lambda i, n: F.struct(i.alias("id"), n.alias("discord_username"))).alias("profiles"), m.alias("matches")), "kuachi")


for provider in (toornament, egb, kuachi):
    query(f"e20_{provider.__name__}_brackets", f"select tournament_id, group_no, round_no, cast(row_number() over (partition by tournament_id, round_no order by match_no) - 1 as int) as match_no, 'name' || substr(p1, 2) as p1, 'name' || substr(p2, 2) as p2, score1, score2, winner from {LONG} l where {PLAYED}")(
        lambda t, provider=provider: PV.normalize(provider(t)).select("tournament_id", "group_no", "round_no", F.col("match_no").cast("int").alias("match_no"), "p1", "p2", "score1", "score2", "winner")
    )


def drawn(t) -> DataFrame:
    """A page a tournament with its bracket in columns, a column a round, the winner's name in bold."""
    cell = lambda k: text('<div class="bracket-cell-r', F.lit(k), '"><div class="bracket-name"', F.when(F.col("winner") == f"p{k}", ' style="font-weight: 700"'), ">", F.col(f"p{k}"), '</div><div class="bracket-score">', F.col(f"score{k}"), "</div></div>")
    match = text('<div class="bracket-match">', cell(1), cell(2), "</div>")
    title = text(F.when(F.col("group_no") == 1, "LB Round ").otherwise("Round "), F.col("round_no"))
    columns = bracket(t).groupBy("tournament_id", "group_no", "round_no").agg(F.first(title).alias("title"), F.array_sort(F.collect_list(F.struct("match_no", match.alias("m")))).alias("m"))
    column = text('<div class="bracket-column"><div class="bracket-round-title">', F.col("title"), "</div>", F.array_join(F.col("m.m"), ""), "</div>")
    return columns.groupBy("tournament_id").agg(F.array_sort(F.collect_list(F.struct("group_no", "round_no", column.alias("c")))).alias("c")).select("tournament_id", text('<div class="bracket">', F.array_join(F.col("c.c"), ""), "</div>").alias("html"))


query("e21_native_brackets", f"select tournament_id, group_no, cast(dense_rank() over (partition by tournament_id, group_no order by round_no) - 1 as int) as round_no, cast(row_number() over (partition by tournament_id, group_no, round_no order by match_no) - 1 as int) as match_no, p1, p2, score1, score2, winner from {LONG} l")(
    lambda t: PV.native(drawn(t)).select("tournament_id", "group_no", "round_no", "match_no", "p1", "p2", "score1", "score2", "winner")
)

# --- stores ---------------------------------------------------------------------------------------


def folder(t) -> str:
    return f"{store.shared_folder(t.spark)}/{uuid.uuid4().hex}"


@query("a4_append", "select game_id, count(*) as n, sum(player1_score) as s from (select * from matches union all select * from matches where match_id % 3 = 0) m group by 1")
def _(t):
    place = folder(t)
    store.append(t.matches, place, "matches", ("game_id",))
    store.append(t.matches.filter("match_id % 3 = 0"), place, "matches", ("game_id",))
    return store.read(t.spark, place, "matches").groupBy("game_id").agg(F.count("*").alias("n"), F.sum("player1_score").alias("s"))


@query("a5_backup_restore", f"select player_id, name, country from players union all select match_id, stage_name, {ts('played_at').split(' as ')[0]} from matches")
def _(t):
    place = folder(t)
    store.backup({"players": t.players, "matches": t.matches}, place)
    back = store.restore(t.spark, place, ["players", "matches"])
    return back["players"].select("player_id", "name", "country").union(back["matches"].select("match_id", "stage_name", at("played_at")))


ASKED = "(select player_id, i, case i when 0 then name when 1 then lower(name) when 2 then '^' || name when 3 then substr(name, 1, 8) when 4 then name || '.' else 'no (' || player_id end as q from players cross join (select unnest([0, 1, 2, 3, 4, 5]) as i) x)"
query("r4_smart_match_mode", f"select player_id, i, case when i in (2, 5) then 'regex' when exists (select 1 from players p where p.name = a.q) then 'exact' else 'partial' end as mode from {ASKED} a")(
    lambda t: R.match_modes(t.players.select("player_id", F.posexplode(F.array("name", F.lower("name"), text("^", F.col("name")), F.substring("name", 1, 8), text(F.col("name"), "."), text("no (", F.col("player_id")))).alias("i", "q")), t.players).select("player_id", "i", "mode")
)

# --- ratings --------------------------------------------------------------------------------------

# The Elo fold in DuckDB, a match of every pool a step, each pool's ratings as a list by player.
FOLD = f"""with recursive duels as (select match_id, played_at, player1_id as a, player2_id as b, pool, coalesce(case when winner_id = player1_id then 1.0 when winner_id = player2_id then 0.0 end, case when player1_score > player2_score then 1.0 when player2_score > player1_score then 0.0 else 0.5 end) as s,
  case lower(trim(coalesce(tr.tier, ''))) when 'premier' then 2.0 when 'major' then 1.5 else 1.0 end as mult
  from matches m left join tournaments tr using (tournament_id) cross join lateral (select unnest([0, m.game_id]) as pool) p where {DUEL}),
 seats as (select pool, match_id, played_at, 1 as side, a as player_id from duels union all select pool, match_id, played_at, 2, b from duels),
 counted as (select pool, match_id, side, row_number() over (partition by pool, player_id order by played_at, match_id, side) - 1 as n from seats),
 steps as materialized (select d.*, row_number() over (partition by d.pool order by d.played_at, d.match_id) as i,
  case when x.n < 30 then 40.0 when x.n <= 100 then 24.0 else 16.0 end * mult as ka, case when y.n < 30 then 40.0 when y.n <= 100 then 24.0 else 16.0 end * mult as kb
  from duels d join counted x on x.pool = d.pool and x.match_id = d.match_id and x.side = 1 join counted y on y.pool = d.pool and y.match_id = d.match_id and y.side = 2),
 fold as (select distinct pool, cast(0 as bigint) as i, cast(null as bigint) as match_id, cast(null as bigint) as a, cast(null as bigint) as b, list_transform(range(0, (select max(player_id) + 1 from players)), lambda x: cast(1500 as double)) as r from duels
  union all select s.pool, s.i, s.match_id, s.a, s.b, list_transform(f.r, lambda x, j: case when j = s.a then x + s.ka * (s.s - 1.0 / (1.0 + pow(10.0, (f.r[s.b] - x) / 400.0))) when j = s.b then x - s.kb * (s.s - 1.0 / (1.0 + pow(10.0, (x - f.r[s.a]) / 400.0))) else x end)
  from fold f join steps s on s.pool = f.pool and s.i = f.i + 1),
 elo as (select a as player_id, pool as game_id, match_id, r[a] as rating from fold where i > 0 union all select b, pool, match_id, r[b] from fold where i > 0)
"""
ORACLES["g2_elo"] = with_views(FOLD + """, results as (select pool, match_id, played_at, a as player_id, s, 1 as side from duels union all select pool, match_id, played_at, b, 1 - s, 2 from duels),
 totals as (select pool, match_id, player_id, cast(sum(cast(s = 1 as int)) over w as bigint) as wins, cast(sum(cast(s = 0 as int)) over w as bigint) as losses, count(*) over w as matches_played
  from results window w as (partition by pool, player_id order by played_at, match_id, side rows between unbounded preceding and current row))
 select e.player_id, game_id, e.match_id, round(rating, 4) as rating, wins, losses, matches_played from elo e join totals t on t.pool = game_id and t.match_id = e.match_id and t.player_id = e.player_id""")
ORACLES["step0_top_by_elo"] = with_views(FOLD + f""", latest as (select e.player_id, max_by(e.rating, (m.played_at, e.match_id)) as rating from elo e join matches m using (match_id) where e.game_id = 0 group by 1),
 tally as (select player_id, count(*) filter (where r = 1) as wins, count(*) filter (where r = 0) as losses, count(*) as matches_played from (select a as player_id, s as r from duels where pool = 0 union all select b, 1 - s from duels where pool = 0) x group by 1)
 select cast(row_number() over (order by l.rating desc, l.player_id) as int) as position, l.player_id, c.name, round(l.rating, 4) as rating, 0.0::double as rd, round(l.rating, 4) as value, wins, losses, matches_played
 from latest l join tally using (player_id) left join ({CANON}) c on c.player_id = l.player_id order by l.rating desc, l.player_id limit 10""")
EARLY = "match_id % 8 > 0 or played_at < timestamp '1998-01-01 00:00:00'"


@query("g3_elo_incremental", FOLD + "select player_id, game_id, match_id, round(rating, 4) as rating from elo")
def _(t):
    first = store.stored(G.elo(t.matches.filter(EARLY), t.tournaments))
    return G.elo_incremental(first, t.matches, t.tournaments).select("player_id", "game_id", "match_id", num("rating"))


@query("g2_elo_swept")
def _(t):
    """The whole history with every pool swept in turns."""
    out = G.elo(t.matches, t.tournaments, fold=0)
    return out.select("player_id", "game_id", "match_id", num("rating"), "wins", "losses", "matches_played")


ORACLES["g2_elo_swept"] = ORACLES["g2_elo"]


@query("g6_glicko2_incremental")
def _(t):
    last = "played_at < timestamp '1998-06-01 00:00:00'"
    first = store.stored(G.glicko2(t.matches.filter(last), "year", keep=store.stored))
    return G.glicko2_incremental(first, t.matches, "year", keep=store.stored).select("player_id", "game_id", "n", "match_id", num("rating"), num("rd"), num("vol", 6))


@query("f8_glicko_update")
def _(t):
    """One Glicko-2 period of all pools from the stored ratings."""
    rows = G.rating_input(t.matches).withColumn("result", S.score_result("player1_score", "player2_score"))
    games = G.sides(rows).withColumn("n", F.lit(9))
    state = t.player_ratings.filter("rating_system = 'glicko2'").select(F.col("game_id").alias("pool"), "player_id", "rating", "rd", "vol", F.lit(7).alias("n"))
    return G.glicko_period(games, state).select("pool", "player_id", num("rating"), num("rd"), num("vol", 6))


# The volatility's root in DuckDB: the same bracket and rounds, for a relation with a, p2, v and d2.
def likelihood(x: str, m: str = "") -> str:
    return f"exp({x}) * ({m}d2 - {m}p2 - {m}v - exp({x})) / (2.0 * pow({m}p2 + {m}v + exp({x}), 2)) - (({x}) - {m}a) / (1.2::double * 1.2::double)"


def rooted(relation: str) -> str:
    """The relation with vol."""
    fall = f"coalesce(list_filter(range(1, 41), lambda i: not ({likelihood('(a - i * 1.2::double)')} < 0))[1] - 1, 40)"
    top = f"case when d2 > p2 + v then ln(greatest(d2 - p2 - v, 1e-300)) else a - ({fall} + 1) * 1.2::double end"
    first = f"{{'a': a, 'p2': p2, 'v': v, 'd2': d2, 'x': a, 'y': y0, 'fx': {likelihood('a')}, 'fy': {likelihood('y0')}}}"
    made = lambda x, y, fx, fy: f"{{'a': m.a, 'p2': m.p2, 'v': m.v, 'd2': m.d2, 'x': {x}, 'y': {y}, 'fx': {fx}, 'fy': {fy}}}"
    turned = f"case when w * m.fy <= 0 then {made('m.y', 'z', 'm.fy', 'w')} else {made('m.x', 'z', 'm.fx / 2.0', 'w')} end"
    step = f"case when abs(m.y - m.x) <= 1e-12 then m else list_transform([m.x + (m.x - m.y) * m.fx / (case when m.fy <> m.fx then m.fy - m.fx else 1.0 end)], lambda z: list_transform([{likelihood('z', 'm.')}], lambda w: {turned})[1])[1] end"
    return f"(select *, exp(list_reduce(list_transform(range(41), lambda i: m0), lambda m, j: {step}).x / 2.0) as vol_new from (select *, {first} as m0 from (select *, {top} as y0 from {relation}) r0) r1)"


ORACLES["f7_volatility"] = with_views(f"""select match_id, round(vol_new, 6) as vol from {rooted(f"(select match_id, ln(pow(0.06::double, 2)) as a, pow(da / 173.7178, 2) as p2, 0.5::double + (match_id % 7) / 10.0::double as v, pow((ra - rb) / 200.0, 2) as d2 from ({PAIR}) q)")} f""")

PERIOD_GAMES = f"""duels as (select match_id, played_at, player1_id as a, player2_id as b, pool, case when player1_score > player2_score then 1.0 when player2_score > player1_score then 0.0 else 0.5 end as s
   from matches m cross join lateral (select unnest([0, m.game_id]) as pool) p where {DUEL}),
 seats as (select pool, match_id, played_at, 1 as side, a as player_id, b as opponent_id, s from duels union all select pool, match_id, played_at, 2, b, a, 1 - s from duels)"""
GAIN = "1.0 / sqrt(1.0 + 3.0 * pow(ord / 173.7178, 2))"


def updated(games: str) -> str:
    """New rating, deviation and volatility of each player from games (pool, player_id, s, pr, prd, pv, orr, ord)."""
    weighed = f"(select *, 1.0 / (1.0 + exp(-g * (pr - orr) / 173.7178)) as e from (select *, {GAIN} as g from {games} g0) g1)"
    per = f"(select pool, player_id, pr, prd, pv, sum(g * g * e * (1 - e)) as info, sum(g * (s - e)) as gain from {weighed} w group by all)"
    known = f"(select *, ln(pow(pv, 2)) as a, pow(prd / 173.7178, 2) as p2, 1.0 / info as v, pow(gain / info, 2) as d2 from {per} p)"
    wide = f"(select *, sqrt(1.0 / (1.0 / p2 + 1.0 / v) + pow(vol_new, 2)) as phi from {rooted(known)} k)"
    return f"(select pool, player_id, pr + 173.7178 * pow(phi, 2) * gain as r, least(350.0, phi * 173.7178) as rd, vol_new as vol from {wide} x)"


ORACLES["f8_glicko_update"] = with_views(f"""with {PERIOD_GAMES},
 held as (select game_id as pool, player_id, rating, least(350.0, sqrt(pow(rd, 2) + pow(173.7178 * vol, 2))) as rd, vol from player_ratings where rating_system = 'glicko2'),
 entered as (select s.pool, s.player_id, s.s, coalesce(p.rating, 1500.0) as pr, coalesce(p.rd, 350.0) as prd, coalesce(p.vol, 0.06::double) as pv, coalesce(o.rating, 1500.0) as orr, coalesce(o.rd, 350.0) as ord
  from seats s left join held p on p.pool = s.pool and p.player_id = s.player_id left join held o on o.pool = s.pool and o.player_id = s.opponent_id)
 select pool, player_id, round(r, 4) as rating, round(rd, 4) as rd, round(vol, 6) as vol from {updated("entered")} u""")


def glicko_body(unit: str, columns: str) -> str:
    """All periods of all pools, a period a step, with the state of every player of every pool."""
    idle = lambda x: f"case when {x}.last is null then 350.0 else least(350.0, sqrt(pow({x}.rd, 2) + greatest({x}.n - {x}.last, 0) * pow(173.7178 * {x}.vol, 2))) end"
    games = f"(select g.pool, g.player_id, g.s, p.r as pr, {idle('p')} as prd, p.vol as pv, o.r as orr, {idle('o')} as ord from st p join played g on g.pool = p.pool and g.player_id = p.player_id and g.n = p.n + 1 join st o on o.pool = g.pool and o.player_id = g.opponent_id)"
    return f"""with recursive {PERIOD_GAMES},
 periods as (select pool, period, row_number() over (partition by pool order by period) as n from (select distinct pool, date_trunc('{unit}', played_at) as period from duels) d),
 played as materialized (select s.*, p.n from seats s join periods p on p.pool = s.pool and p.period = date_trunc('{unit}', s.played_at)),
 st as (select distinct pool, player_id, cast(0 as bigint) as n, cast(1500 as double) as r, cast(350 as double) as rd, cast(0.06 as double) as vol, cast(null as bigint) as last from seats
  union all select s.pool, s.player_id, s.n + 1, coalesce(u.r, s.r), coalesce(u.rd, s.rd), coalesce(u.vol, s.vol), case when u.r is not null then s.n + 1 else s.last end
  from st s left join {updated(games)} u on u.pool = s.pool and u.player_id = s.player_id where s.n < (select max(n) from periods)),
 totals as (select *, cast(sum(cast(s = 1 as int)) over w as bigint) as wins, cast(sum(cast(s = 0 as int)) over w as bigint) as losses, count(*) over w as matches_played
  from played window w as (partition by pool, player_id order by played_at, match_id, side rows between unbounded preceding and current row)),
 tags as (select pool, player_id, n, max_by({{'match_id': match_id, 'wins': wins, 'losses': losses, 'matches_played': matches_played}}, (played_at, match_id)) as t from totals group by 1, 2, 3)
 select player_id, pool as game_id, cast(n as int) as n, t.match_id, round(r, 4) as rating, round(rd, 4) as rd, round(vol, 6) as vol{columns} from st join tags using (pool, player_id, n)"""


ORACLES["g4_glicko2"] = with_views(glicko_body("month", ", t.wins, t.losses, t.matches_played"))
ORACLES["g6_glicko2_incremental"] = with_views(glicko_body("year", ""))
ORACLES["g12_rate_all"] = with_views(f"""select player_id, game_id, 'elo' as rating_system, match_id, rating from ({FOLD} select player_id, game_id, match_id, round(rating, 4) as rating from elo) e
 union all select player_id, game_id, 'glicko2', match_id, rating from ({glicko_body("year", "")}) g""")
query("g12_rate_all")(lambda t: G.rate_all(t.matches, t.tournaments, "year").select("player_id", "game_id", "rating_system", "match_id", num("rating")))
SPELLINGS = [*S.GAME_ALIASES, "Other Game"]


def spelled(number: Column) -> Column:
    """Each alias in turn, some in upper case or with blanks; then a name that is none."""
    each = F.element_at(F.array(*map(F.lit, SPELLINGS)), (number % len(SPELLINGS) + 1).cast("int"))
    return F.when(number % len(SPELLINGS) == len(SPELLINGS) - 1, each).when(number % 3 == 0, F.upper(each)).when(number % 3 == 1, text(" ", each, " ")).otherwise(each)


query("f18_game_aliases", f"""select match_id, case i {" ".join(f"when {i} then '{g}'" for i, g in enumerate(S.GAME_ALIASES.values()))} else 'Other Game' end as game from (select match_id, match_id % {len(SPELLINGS)} as i from matches) m""")(
    lambda t: t.matches.select("match_id", S.resolve_game(spelled(F.col("match_id"))).alias("game"))
)
query("f19_unescape", "select match_id, 'é & ' || chr(cast(65 + match_id % 26 as int)) || ' ' || chr(cast(228 + match_id % 20 as int)) || ' &nosuch; <' || match_id || '>' as text from matches")(
    lambda t: t.matches.select("match_id", S.unescape(text("&eacute; &amp; &#", F.col("match_id") % 26 + 65, "; &#x", F.hex(F.col("match_id") % 20 + 228), "; &nosuch; &lt;", F.col("match_id"), "&gt;")).alias("text"))
)
query("g9_corrupt_ratings", "select game_id, count(*) filter (where match_id % 50 in (0, 1, 2, 3)) as bad from rating_history group by 1")(
    lambda t: t.rating_history.withColumn("rating", F.expr("case match_id % 50 when 0 then -1.0 when 1 then double('NaN') when 2 then null when 3 then 10001.0 else rating end")).groupBy("game_id").agg(F.count_if(G.corrupt()).alias("bad"))
)

# --- streams, drained -----------------------------------------------------------------------------


SHIFT = 1_000_000_000
TOLD = f"(select player_id, name from (select player1_id as player_id, a.name from {LIVE} m join players a on a.player_id = player1_id union all select player2_id, b.name from {LIVE} m join players b on b.player_id = player2_id) x)"
query("s1_a8_stream_parse", f"""select 'matches' as name, count(*) as n, cast(sum(match_id + 3 * player1_id + 5 * player2_id) as bigint) as s from {LIVE} m
 union all select 'match_maps', count(*), cast(sum(match_id + mm.player1_score) as bigint) from match_maps mm join (select match_id from {LIVE} l) k using (match_id)
 union all select 'match_vods', count(*), cast(sum(vod_post_id) as bigint) from match_vods join (select match_id from {LIVE} l) k using (match_id)
 union all select 'raw_posts', (select count(*) from matches) + (select count(*) from tournaments), (select cast(sum(match_id) as bigint) from matches) + (select cast(sum(tournament_id + {SHIFT}) as bigint) from tournaments)
 union all select 'standings', count(*), cast(sum(player_id) as bigint) from (select cast(rankings::json->(i::int)->>'player_id' as bigint) as player_id from tournaments cross join (select unnest([0, 1]) as i) x) y
 union all select 'players', count(distinct player_id), cast(sum(distinct player_id) as bigint) from {TOLD} p
 union all select 'games', count(distinct game_id), cast(sum(distinct game_id) as bigint) from {LIVE} m
 union all select 'tournaments', count(distinct id), cast(sum(distinct id) as bigint) from (select tournament_id as id from {LIVE} m where tournament_id is not null union all select tournament_id + {SHIFT} from tournaments union all select match_id from matches where match_id % {KINDS} = 6) i
 union all select 'aliases', count(*), cast(sum(cnt * player_id) as bigint) from (select player_id, name, count(*) as cnt from {TOLD} p group by 1, 2) c""")(lambda t: drained_parse(t))


def drained_parse(t) -> DataFrame:
    """What all tables hold after a stream of pages was parsed and every batch of it was delivered again."""
    place = folder(t)
    pages = match_pages(t).unionByName(tournament_pages(t).withColumn("post_id", F.col("post_id") + SHIFT))
    pages.write.options(**store.LONG_VALUES).parquet(f"{place}/posts")
    silver = ST.Silver(t.spark, f"{place}/silver", 2)
    for state, again in (("first", False), ("second", True)):
        posts = t.spark.readStream.schema("post_id long, raw_html string").parquet(f"{place}/posts")
        silver.follow(posts, "posts", f"{place}/{state}", again).awaitTermination()
    sums = {
        "matches": F.col("match_id") + 3 * F.col("player1_id") + 5 * F.col("player2_id"), "match_maps": F.col("match_id") + F.col("player1_score"), "match_vods": F.col("vod_post_id"), "raw_posts": F.col("post_id"),
        "standings": F.col("player_id"), "players": F.col("player_id"), "games": F.col("game_id"), "tournaments": F.col("tournament_id"), "aliases": F.col("cnt") * F.col("player_id"),
    }
    read = lambda name: silver.read(name).groupBy("player_id", "name").agg(F.count("*").alias("cnt")) if name == "aliases" else silver.read(name)
    return reduce(DataFrame.unionByName, [read(name).agg(F.count("*").alias("n"), F.sum(s).cast("bigint").alias("s")).select(F.lit(name).alias("name"), "n", "s") for name, s in sums.items()])


@query("s3_stream_ratings", FOLD + "select player_id, game_id, match_id, round(rating, 4) as rating from elo")
def _(t):
    """Matches in two batches by time, and a third with late ones: every 31st and, from 1998 on, every eighth."""
    place = folder(t)
    late, new = F.expr(f"not ({EARLY}) or match_id % 31 = 0"), F.col("played_at") >= F.lit("1997-01-01").cast("timestamp")
    turn = F.when(late, 2).when(new, 1).otherwise(0)
    for i in range(3):
        t.matches.filter(turn == i).write.parquet(f"{place}/{i}")
    held = ST.Ratings(t.spark, f"{place}/ratings", t.tournaments, "year")
    for i in range(3):  # one after the other, so that the order is fixed
        posts = t.spark.readStream.schema(t.matches.schema).parquet(f"{place}/{i}")
        posts.writeStream.foreachBatch(lambda df, _, i=i: held.add(df, i)).option("checkpointLocation", f"{place}/state-{i}").trigger(availableNow=True).start().awaitTermination()
    return held.history().select("player_id", F.col("game_id").cast("int").alias("game_id"), "match_id", num("rating"))


@query("s6_stream_embeds", "select event_id as vod_post_id, case when event_id % 3 = 0 then 'v' || event_id end as video_id from events where ts <= (select max(ts) - interval 9 day from events)")
def _(t):
    vods = ST.events(t.spark, t.dir).select(F.col("event_id").alias("vod_post_id"), "ts")
    embeds = ST.events(t.spark, t.dir).filter("event_id % 3 = 0").select(F.col("event_id").alias("post_id"), F.col("ts").alias("seen"), text("v", F.col("event_id")).alias("video_id"))
    end = t.base("events").agg(F.max("ts").cast("timestamp").alias("end"))
    return ST.drained(ST.link_embeds(vods, embeds)).crossJoin(F.broadcast(end)).filter("ts <= end - interval 9 days").select("vod_post_id", "video_id")


query("s7_stream_due", "select post_id from raw_posts where status = 'skipped' and reason = 'not played' and sort_time <= timestamp '2024-02-15 00:00:00'")(lambda t: drained_due(t))


def drained_due(t) -> DataFrame:
    place = folder(t)
    t.raw_posts.drop("raw_html").write.parquet(f"{place}/posts")
    posts = t.spark.readStream.schema("post_id long, status string, reason string, sort_time timestamp").parquet(f"{place}/posts")
    return ST.drained(ST.due_posts(posts, "2024-02-15 00:00:00")).select("post_id")


VISITED = "timestamp '2024-03-20 00:00:00'"
query("s7_stream_revisits", f"select page_id as post_id, strftime(due, '%Y-%m-%d %H:%M:%S') as due from (select page_id, timestamp '2024-01-01 00:00:00' + interval '1' day * (page_id * 37 % 100) as due from pages) p where page_id % 4 > 0 and page_id % 5 > 0 and due <= {VISITED} and due > timestamp '2024-01-01 00:00:00'")(
    lambda t: drained_revisits(t)
)


def drained_revisits(t) -> DataFrame:
    """Posts scheduled for later; every fifth is parsed the day before, others after; every fourth was never scheduled."""
    place = folder(t)
    posts = t.raw_posts.select("post_id", "sort_time")
    start, none = F.lit("2024-01-01").cast("timestamp"), F.lit(None).cast("timestamp")
    first = posts.filter("sort_time > timestamp '2024-01-01'").select("post_id", F.lit("skipped").alias("status"), F.when(F.col("post_id") % 4 > 0, "not played").otherwise("team format").alias("reason"), "sort_time", start.alias("seen"))
    second = posts.filter("sort_time > timestamp '2024-01-01'").select("post_id", F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("reason"), none.alias("sort_time"), F.when(F.col("post_id") % 5 == 0, F.col("sort_time") - F.expr("interval 12 hours")).otherwise(F.col("sort_time") + F.expr("interval 12 hours")).alias("seen"))
    last = posts.agg(F.lit(-1).cast("bigint").alias("post_id")).select("post_id", F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("reason"), none.alias("sort_time"), F.lit("2024-03-20").cast("timestamp").alias("seen"))
    events = first.unionByName(second).filter("seen <= timestamp '2024-03-20'").unionByName(last)
    events.write.parquet(f"{place}/posts")
    stream = t.spark.readStream.schema("post_id long, status string, reason string, sort_time timestamp, seen timestamp").parquet(f"{place}/posts")
    return ST.drained(ST.revisits(stream)).select("post_id", at("due"))
