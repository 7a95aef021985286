"""Registered queries over the match data model, each with the DuckDB query that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.functions import scalars as S
from rankforge.operators import leaderboard as L
from rankforge.operators import matches as M
from rankforge.operators import players as P
from rankforge.operators import ratings as G
from rankforge.operators import relational as R
from rankforge.operators import tournaments as T
from rankforge.sources.store import stored, stored_in_portions
from rankforge.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


def at(col: str, alias: str | None = None):
    """A time as text, the same in both engines."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(alias or col)


def in_portions(t: Tables, df: DataFrame) -> DataFrame:
    """df, worked out by tasks as many as the matches need."""
    return stored_in_portions(df, t.base("orders").count())


def num(col, digits: int = 4, alias: str | None = None):
    out = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return out.alias(alias or col) if isinstance(alias or col, str) else out


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {1}"


def ts(x: str, alias: str | None = None) -> str:
    return TS.format(x, alias or x.split(".")[-1])


SIDES = """(select match_id, winner_id, game_id, tournament_id, match_format, played_at, player1_id as player_id, player2_id as opponent_id, player1_score as score, player2_score as opponent_score, player1_country as country, 1 as side from matches
 union all select match_id, winner_id, game_id, tournament_id, match_format, played_at, player2_id, player1_id, player2_score, player1_score, player2_country, 2 from matches)"""
VALUE = "case when rating_system = 'glicko2' then rating - coalesce(rd, 0) else rating end"
DUEL = "((lower(match_format) like '%duel%' and lower(match_format) not like '%team%') or lower(match_format) like '%1v1%')"

# --- scans and building blocks --------------------------------------------------------------------

query("a1_scan_table", f"select match_id, player1_id, player2_id, player1_score, player2_score, {ts('played_at')} from matches where game_id = 1")(
    lambda t: t.matches.filter("game_id = 1").select("match_id", "player1_id", "player2_id", "player1_score", "player2_score", at("played_at"))
)
query("a2_scan_posts", f"select post_id, {ts('sort_time')} from raw_posts where status = 'downloaded' order by sort_time, post_id limit 25")(
    lambda t: R.page(t.raw_posts.filter("status = 'downloaded'").select("post_id", "sort_time"), [F.col("sort_time").asc(), F.col("post_id").asc()], 25).select("post_id", at("sort_time"))
)
query("a3_point_lookup", "select match_id, player1_id, player2_id, match_format from matches where match_id = 42")(
    lambda t: t.matches.filter("match_id = 42").select("match_id", "player1_id", "player2_id", "match_format")
)


@query("a6_reset_parsed", "select case when status in ('parsed', 'skipped') then 'downloaded' else status end as status, case when status in ('parsed', 'skipped') then '' else coalesce(reason, '') end as reason, count(*) as n from raw_posts group by 1, 2")
def _(t):
    from rankforge.sources.store import reset_posts

    return reset_posts(t.raw_posts).groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("a7_table_counts", " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in ("players", "games", "matches", "match_maps", "maps", "tournaments", "player_aliases", "match_vods", "raw_posts")))
def _(t):
    from rankforge.sources.store import table_counts

    return table_counts({n: getattr(t, n) for n in ("players", "games", "matches", "match_maps", "maps", "tournaments", "player_aliases", "match_vods", "raw_posts")})


query("r1_latest_by_key", "select match_id, map_index, map_id, player1_score, player2_score from match_maps")(
    lambda t: R.latest_by_key(t.match_maps_raw, ["match_id", "map_index"], ["version_ts", "version_k1", "version_k2", "map_id", "player1_score"]).select("match_id", "map_index", "map_id", "player1_score", "player2_score")
)
query("r2_filter", "select match_id, case when player1_score > 2 or (player2_score >= 2 and game_id in (1, 3)) then 'high' else 'low' end as class from matches where player1_score <> player2_score and game_id <= 4")(
    lambda t: t.matches.filter("player1_score <> player2_score and game_id <= 4").select("match_id", F.when((F.col("player1_score") > 2) | ((F.col("player2_score") >= 2) & F.col("game_id").isin(1, 3)), "high").otherwise("low").alias("class"))
)
query("r3_text_match", "select tournament_id, name, 'partial' as mode from tournaments where name ilike '%12%' union all select tournament_id, name, 'regex' from tournaments where regexp_matches(lower(name), '(1|2)7$') union all select tournament_id, name, 'exact' from tournaments where name = (select min(name) from tournaments where tournament_id = 7)")(
    lambda t: t.tournaments.filter(R.text_match("name", "12", "partial"))
    .select("tournament_id", "name", F.lit("partial").alias("mode"))
    .union(t.tournaments.filter(R.text_match("name", "(1|2)7$", "regex")).select("tournament_id", "name", F.lit("regex")))
    .union(t.tournaments.filter("tournament_id = 7").select("name").join(t.tournaments.select("tournament_id", "name"), "name").select("tournament_id", "name", F.lit("exact")))
)
query("r5_inner_join", "select m.game_id, count(*) as maps, cast(sum(mm.player1_score) as bigint) as frags from matches m join match_maps mm on m.match_id = mm.match_id group by 1")(
    lambda t: t.matches.join(t.match_maps.select("match_id", F.col("player1_score").alias("f")), "match_id").groupBy("game_id").agg(F.count("*").alias("maps"), F.sum("f").alias("frags"))
)
query("r6_names_join", "select m.match_id, a.name as player1, b.name as player2 from matches m left join players a on a.player_id = m.player1_id left join players b on b.player_id = m.player2_id")(
    lambda t: R.with_names(t.matches, t.players).select("match_id", "player1", "player2")
)
query("r7_semi_join", "select tournament_id from tournaments where tournament_id in (select tournament_id from matches)")(lambda t: R.exists_in(t.tournaments.select("tournament_id"), t.matches, "tournament_id"))
query("r8_anti_join", "select tournament_id from tournaments where tournament_id not in (select tournament_id from matches where tournament_id is not null and game_id = 1)")(
    lambda t: R.not_in(t.tournaments.select("tournament_id"), t.matches.filter("game_id = 1 and tournament_id is not null"), "tournament_id")
)
ODD = "rating_system = 'elo' or month(played_at) % 2 = 1"


@query("r9_asof_forward", f"select e.player_id, e.game_id, e.match_id, g.rating as asof_rating from (select *, date_trunc('month', played_at) as p from rating_history where rating_system = 'elo') e asof left join (select *, date_trunc('month', played_at) as p from rating_history where rating_system = 'glicko2' and month(played_at) % 2 = 1) g on e.player_id = g.player_id and e.game_id = g.game_id and e.p >= g.p")
def _(t):
    return P.history_both(t.rating_history.filter(ODD)).select("player_id", "game_id", "match_id", "asof_rating")


query("r10_before_time", "select player_id, game_id, rating_system, max_by(match_id, (played_at, match_id)) as match_id, max_by(rating, (played_at, match_id)) as rating from rating_history where played_at < timestamp '1996-06-01 00:00:00' group by 1, 2, 3")(
    lambda t: R.before(t.rating_history, F.lit("1996-06-01 00:00:00").cast("timestamp"), L.KEY).select(*L.KEY, "match_id", "rating")
)
query("r11_participants", f"select match_id, player_id, opponent_id, score, country from {SIDES} s where game_id = 2")(lambda t: R.participants(t.matches.filter("game_id = 2")).select("match_id", "player_id", "opponent_id", "score", "country"))
query("r11_participants_all", f"select match_id, player_id, opponent_id, score, country from {SIDES} s")(lambda t: R.participants(t.matches).select("match_id", "player_id", "opponent_id", "score", "country"))
query("r12_arg_max", "select player_id, game_id, rating_system, max_by(rating, (played_at, match_id)) as rating, max_by(match_id, (played_at, match_id)) as match_id from rating_history group by 1, 2, 3")(
    lambda t: R.last_by(t.rating_history, L.KEY).select(*L.KEY, "rating", "match_id")
)
query("r13_limit_by", "select player_id, match_id, rating from (select *, row_number() over (partition by player_id order by rating desc, match_id) as rn from rating_history where rating_system = 'elo' and game_id = 0) h where rn <= 3")(
    lambda t: R.top_by(t.rating_history.filter("rating_system = 'elo' and game_id = 0"), ["player_id"], [F.col("rating").desc(), F.col("match_id").asc()], 3).select("player_id", "match_id", "rating")
)
query("r14_aggregates", f"select game_id, count(*) as n, count(distinct player1_id) as p, count(*) filter (where winner_id is null) as draws, cast(sum(player1_score) as bigint) as s, {ts('min(played_at)', 'lo')}, {ts('max(played_at)', 'hi')}, min(match_format) as f from matches group by 1")(
    lambda t: t.matches.groupBy("game_id")
    .agg(F.count("*").alias("n"), F.count_distinct("player1_id").alias("p"), F.count_if(F.col("winner_id").isNull()).alias("draws"), F.sum("player1_score").alias("s"), F.min("played_at").alias("lo"), F.max("played_at").alias("hi"), F.min("match_format").alias("f"))
    .select("game_id", "n", "p", "draws", "s", at("lo"), at("hi"), "f")
)
query("r15_having", f"select player_id, count(*) as n from {SIDES} s group by 1 having count(*) >= 290")(lambda t: R.participants(t.matches).groupBy("player_id").agg(F.count("*").alias("n")).filter("n >= 290"))
query("r16_page", f"select match_id, {ts('played_at')} from matches order by played_at desc, match_id desc limit 50 offset 100")(lambda t: R.page(t.matches.select("match_id", "played_at"), R.match_order(), 50, 100).select("match_id", at("played_at")))
query("r17_distinct", "select distinct player1_id, game_id from matches")(lambda t: t.matches.select("player1_id", "game_id").distinct())
query("r18_derived", "select match_format, cast(max(n) as bigint) as most from (select match_format, player1_id, count(*) as n from matches group by 1, 2) x group by 1")(
    lambda t: t.matches.groupBy("match_format", "player1_id").agg(F.count("*").alias("n")).groupBy("match_format").agg(F.max("n").alias("most"))
)
query("r19_or_initial", "select p.player_id, coalesce(r.rating, 1500.0) as rating, coalesce(r.rd, 350.0) as rd from players p left join (select * from player_ratings where game_id = 3 and rating_system = 'glicko2') r on p.player_id = r.player_id")(
    lambda t: R.or_initial(t.players.select("player_id"), t.player_ratings.filter("game_id = 3 and rating_system = 'glicko2'").select("player_id", "rating", "rd"), ["player_id"], {"rating": 1500.0, "rd": 350.0})
)
query("r20_previous", "select player_id, game_id, rating_system, match_id, coalesce(lag(rating) over (partition by player_id, game_id, rating_system order by played_at, match_id), 1500.0) as previous from rating_history")(
    lambda t: R.previous(t.rating_history).select(*L.KEY, "match_id", "previous")
)
query("r21_tier_order", "select tournament_id, tier from tournaments order by tier is null, case tier when 'premier' then 0 when 'major' then 1 else 2 end, tournament_id limit 600")(
    lambda t: t.tournaments.orderBy(*R.tier_order(True), "tournament_id").limit(600).select("tournament_id", "tier")
)


@query("r21_tier_positions", "select tournament_id, tier, dense_rank() over (order by tier is null, case tier when 'premier' then 0 when 'major' then 1 else 2 end, tier) as position from tournaments")
def _(t):
    tiers = t.tournaments.select("tier").distinct()  # few by nature
    order = Window.orderBy(*R.tier_order(True), F.col("tier").asc_nulls_last())
    tiers = tiers.select(F.col("tier").alias("of"), F.dense_rank().over(order).cast("long").alias("position"))
    return t.tournaments.join(F.broadcast(tiers), F.expr("tier <=> of")).select("tournament_id", "tier", "position")


query("r22_sort_players", "select player_id, win_rate from (select player_id, round(wins / matches_played, 4) as win_rate, wins / matches_played as w from player_ratings where game_id = 0 and rating_system = 'elo') x order by w desc nulls last, player_id limit 20")(
    lambda t: t.player_ratings.filter("game_id = 0 and rating_system = 'elo'").orderBy(*R.player_order("win_rate")).limit(20).select("player_id", num(S.win_rate("wins", "matches_played"), 4, "win_rate"))
)
query("r23_sort_tournaments", "select tournament_id, name from tournaments order by lower(name), tournament_id limit 30")(lambda t: t.tournaments.orderBy(*R.tournament_order("name", False)).limit(30).select("tournament_id", "name"))
query("r24_sort_matches", "select match_id, player1_score, player2_score from matches order by player1_score + player2_score desc, player1_score desc, match_id desc limit 40")(
    lambda t: t.matches.orderBy(*R.match_order("score")).limit(40).select("match_id", "player1_score", "player2_score")
)
query("r25_count", "select count(*) as n from matches m join tournaments t on m.tournament_id = t.tournament_id where t.tier = 'major'")(
    lambda t: M.selected(t.matches, t.players, t.tournaments, tier="major").agg(F.count("*").alias("n"))
)
query("r26_widths", "select cast(max(strlen(a.name)) as bigint) as player1, cast(max(strlen(b.name)) as bigint) as player2, cast(max(strlen(m.match_format)) as bigint) as match_format from matches m left join players a on a.player_id = m.player1_id left join players b on b.player_id = m.player2_id")(
    lambda t: R.widths(R.with_names(t.matches, t.players), ["player1", "player2", "match_format"])
)

TFACT = f"(select tournament_id, min(played_at) as first_match, max(played_at) as last_match, count(distinct match_id) as matches, count(distinct player_id) as players from {SIDES} s where tournament_id is not null group by 1)"

# Ten rows of each order, with their places; sql maps a column to its DuckDB order without direction.


def places(rows: DataFrame, order: Callable[[str, bool], list], columns: list[str], key: str) -> DataFrame:
    def one(column: str, down: bool) -> DataFrame:
        page = R.page(rows, order(column, down), 10)
        place = F.row_number().over(Window.orderBy(*order(column, down)))  # of one page
        return page.select(F.lit(column).alias("by"), F.lit(down).alias("descending"), place.cast("long").alias("position"), key)

    return reduce(DataFrame.unionByName, [one(c, d) for c in columns for d in (True, False)])


def places_sql(rows: str, columns: dict[str, str], key: str, falls: bool = False) -> str:
    def one(column: str, order: str, down: bool) -> str:
        way = "desc" if down else "asc"
        order = ", ".join(f"{x} {way} nulls last" for x in order.split(" | "))
        return f"select '{column}' as by, {down} as descending, row_number() over (order by {order}, {key} {way if falls else 'asc'}) as position, {key} from {rows} z qualify position <= 10"

    return " union all ".join(one(c, o, d) for c, o in columns.items() for d in (True, False))


LEADERS = """(select r.*, n.name, wins / matches_played as win_rate, h.peak, h.peak_date from player_ratings r left join players n using (player_id)
 left join (select player_id, max(rating) as peak, max_by(played_at, (rating, played_at)) as peak_date from rating_history where game_id = 0 and rating_system = 'elo' group by 1) h using (player_id) where game_id = 0 and rating_system = 'elo')"""
TIER = "case tier when 'premier' then -0 when 'major' then -1 when 'minor' then -2 end"
LEADER_ORDERS = {"win_rate": "win_rate", "name": "lower(name)", "rating": "rating", "rd": "rd", "peak": "peak", "peak_date": "peak_date", "wins": "wins", "losses": "losses", "matches": "matches_played"}


def leaders(t) -> DataFrame:
    peaks = t.rating_history.filter("game_id = 0 and rating_system = 'elo'").groupBy("player_id").agg(F.max("rating").alias("peak"), F.max_by("played_at", F.struct("rating", "played_at")).alias("peak_date"))
    own = t.player_ratings.filter("game_id = 0 and rating_system = 'elo'")
    return own.join(t.players.select("player_id", "name"), "player_id", "left").join(peaks, "player_id", "left")


query("r22_sort_players_by", places_sql(LEADERS, LEADER_ORDERS, "player_id"))(lambda t: places(stored(leaders(t)), R.player_order, list(LEADER_ORDERS), "player_id"))
EVENTS = f"""(select t.*, g.name as game, f.first_match, f.last_match, coalesce(f.matches, 0) as matches, coalesce(f.players, 0) as players, len(list_distinct(string_split(maplist_csv, ','))) as maps
 from tournaments t left join games g using (game_id) left join {TFACT} f using (tournament_id))"""
EVENT_ORDERS = {"name": "lower(name)", "tier": TIER, "game": "lower(game)", "maps": "maps", "matches": "matches", "players": "players", "last_match": "last_match", "first_match": "first_match"}
query("r23_sort_tournaments_by", places_sql(EVENTS, EVENT_ORDERS, "tournament_id"))(
    lambda t: places(stored(T.overview(t.tournaments, t.matches).join(t.games.select("game_id", F.col("name").alias("game")), "game_id", "left")), R.tournament_order, list(EVENT_ORDERS), "tournament_id")
)
NAMED_MATCHES = "(select m.*, a.name as player1, t.name as tournament, t.tier from matches m left join players a on a.player_id = m.player1_id left join tournaments t using (tournament_id))"
query("r24_sort_matches_by", places_sql(NAMED_MATCHES, {"score": "player1_score + player2_score | player1_score", "played_at": "played_at", "tier": TIER, "player1": "lower(player1)", "tournament": "lower(tournament)", "match_format": "match_format"}, "match_id", True))(
    lambda t: places(M.named(t.matches, t.players, t.tournaments, t.games), R.match_order, ["score", "played_at", "tier", "player1", "tournament", "match_format"], "match_id")
)

# --- scalar functions -----------------------------------------------------------------------------

RESULT = "case when winner_id = player1_id then 1.0 when winner_id = player2_id then 0.0 when player1_score > player2_score then 1.0 when player2_score > player1_score then 0.0 else 0.5 end"
query("f1_match_result", f"select match_id, cast({RESULT} as double) as result from matches")(lambda t: t.matches.select("match_id", S.match_result("player1_id", "player2_id", "player1_score", "player2_score", "winner_id").alias("result")))
query("f2_f3_k_factor", "select r.player_id, r.match_id, case when matches_played < 30 then 40.0::double when matches_played <= 100 then 24.0::double else 16.0::double end * case lower(t.tier) when 'premier' then 2.0::double when 'major' then 1.5::double else 1.0::double end as k from rating_history r join matches m on r.match_id = m.match_id left join tournaments t on m.tournament_id = t.tournament_id where r.game_id = 0 and r.rating_system = 'elo'")(
    lambda t: t.rating_history.filter("game_id = 0 and rating_system = 'elo'").join(t.matches.select("match_id", "tournament_id"), "match_id").join(t.tournaments.select("tournament_id", "tier"), "tournament_id", "left").select("player_id", "match_id", S.k_factor(F.coalesce("tier", F.lit("")), "matches_played").alias("k"))
)
PAIR = "select match_id, max(case when side = 1 then rating end) as ra, max(case when side = 2 then rating end) as rb, max(case when side = 1 then rd end) as da, max(case when side = 2 then rd end) as db from (select s.match_id, s.side, r.rating, 350.0 - s.match_id % 300 as rd from " + SIDES + " s join rating_history r on r.match_id = s.match_id and r.player_id = s.player_id where r.game_id = 0 and r.rating_system = 'elo') x group by 1"


def rating_pairs(t):
    rows = R.participants(t.matches).join(t.rating_history.filter("game_id = 0 and rating_system = 'elo'").select("match_id", "player_id", "rating"), ["match_id", "player_id"])
    rows = rows.withColumn("rd", 350.0 - F.col("match_id") % 300)
    side = lambda c, n: F.max(F.when(F.col("side") == n, F.col(c)))
    return rows.groupBy("match_id").agg(side("rating", 1).alias("ra"), side("rating", 2).alias("rb"), side("rd", 1).alias("da"), side("rd", 2).alias("db"))


query("f4_f5_elo_step", f"select match_id, round(1 / (1 + pow(10, (rb - ra) / 400)), 6) as expected, round(ra + 24 * (1 - 1 / (1 + pow(10, (rb - ra) / 400))), 4) as won, round(rb - 16 * (1 - 1 / (1 + pow(10, (rb - ra) / 400))), 4) as lost from ({PAIR}) p")(
    lambda t: rating_pairs(t).select("match_id", num(S.elo_expected("ra", "rb"), 6, "expected"), num(S.elo_update("ra", "rb", 1.0, 24.0, 16.0)[0], 4, "won"), num(S.elo_update("ra", "rb", 1.0, 24.0, 16.0)[1], 4, "lost"))
)
query("f6_glicko_weights", f"select match_id, round(1 / sqrt(1 + 3 * pow(db / 173.7178, 2)), 6) as g, round(1 / (1 + exp(-(1 / sqrt(1 + 3 * pow(db / 173.7178, 2))) * (ra - rb) / 173.7178)), 6) as e from ({PAIR}) p")(
    lambda t: rating_pairs(t).select("match_id", num(S.glicko_g("db"), 6, "g"), num(S.glicko_expected("ra", "rb", "db"), 6, "e"))
)
query("f7_volatility")(
    lambda t: rating_pairs(t).select("match_id", num(S.glicko_volatility(F.col("da") / S.SCALE, F.lit(0.06), F.lit(0.5) + (F.col("match_id") % 7) / 10.0, (F.col("ra") - F.col("rb")) / 200.0), 6, "vol"))
)
query("f9_conservative", f"select player_id, game_id, rating_system, {VALUE} as value from player_ratings")(lambda t: t.player_ratings.select(*L.KEY, L.ranking_value().alias("value")))
query("f10_periods", f"select distinct {ts("date_trunc('week', played_at)", 'week')}, {ts("date_trunc('month', played_at)", 'month')}, strftime(played_at, '%Y-%m') as month_key, strftime(played_at, '%G-W%V') as week_key from matches")(
    lambda t: t.matches.select(F.date_format(S.period_start("played_at", "week"), "yyyy-MM-dd HH:mm:ss").alias("week"), F.date_format(S.period_start("played_at", "month"), "yyyy-MM-dd HH:mm:ss").alias("month"), S.period_key("played_at", "month").alias("month_key"), S.period_key("played_at", "week").alias("week_key")).distinct()
)
query("f11_winner_name", "select m.match_id, case when winner_id = player1_id then a.name when winner_id = player2_id then b.name end as winner from matches m left join players a on a.player_id = m.player1_id left join players b on b.player_id = m.player2_id")(
    lambda t: R.with_names(t.matches, t.players).select("match_id", S.winner_name("player1_id", "player2_id", "winner_id", "player1", "player2").alias("winner"))
)
query("f12_duel_filter", f"select match_id, match_format from matches where {DUEL}")(lambda t: P.duels(t.matches).select("match_id", "match_format"))
query("f14_ordinal_rank", "select tournament_id, position, coalesce(try_cast(regexp_extract(position, '^(\\d+)', 1) as int), 0) as place from (select tournament_id, unnest(['1st', '2nd', '11th', '', 'x3', cast(tournament_id % 40 as varchar) || 'th']) as position from tournaments) s")(
    lambda t: t.tournaments.select("tournament_id", F.explode(F.array(F.lit("1st"), F.lit("2nd"), F.lit("11th"), F.lit(""), F.lit("x3"), F.concat((F.col("tournament_id") % 40).cast("string"), F.lit("th")))).alias("position")).select("tournament_id", "position", S.ordinal_rank("position").alias("place"))
)
query("f15_parse_dates", f"select match_id, {ts("date_trunc('day', played_at)", 'list_date')}, {ts("date_trunc('day', played_at)", 'long_date')} from matches")(
    lambda t: t.matches.select(
        "match_id",
        F.date_format(S.parse_list_date(F.concat(F.date_format("played_at", "dd MMM yyyy"), F.lit(" 00:00 UTC"))), "yyyy-MM-dd HH:mm:ss").alias("list_date"),
        F.date_format(S.parse_ordinal_date(F.concat(F.date_format("played_at", "d"), F.lit("th "), F.date_format("played_at", "MMMM yyyy")), F.lit("0:00 UTC")), "yyyy-MM-dd HH:mm:ss").alias("long_date"),
    )
)
query("f16_vod_url", "select vod_post_id, case platform when 'youtube' then 'https://www.youtube.com/watch?v=' || video_id when 'twitch' then 'https://www.twitch.tv/videos/' || video_id when 'vimeo' then 'https://vimeo.com/' || video_id else '' end as url from match_vods")(
    lambda t: t.match_vods.select("vod_post_id", S.vod_url("platform", "video_id").alias("url"))
)
query("f17_slug", "select tournament_id, regexp_replace(regexp_replace(lower(regexp_replace(name, '[^\\w\\s-]', '', 'g')), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from tournaments")(lambda t: t.tournaments.select("tournament_id", S.slug("name").alias("slug")))
query("f18_game_alias", "select game_id, name from games")(lambda t: t.games.select("game_id", S.resolve_game("name").alias("name")))
query("f19_strip_html", "select page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) as n from pages")(lambda t: t.base("pages").select("page_id", F.char_length(S.strip_tags("html")).cast("bigint").alias("n")))
query("f21_f22_scores", "select s.match_id, s.player_id, s.score || '-' || s.opponent_score as score from " + SIDES + " s where side = 2")(
    lambda t: t.matches.select("match_id", F.col("player2_id").alias("player_id"), S.oriented_score("player2_id", "player2_id", "player1_score", "player2_score").alias("score"))
)

query("f21_f22_scores_both", "select s.match_id, s.player_id, s.score || '-' || s.opponent_score as score from " + SIDES + " s")(
    lambda t: t.matches.select("*", F.explode(F.array("player1_id", "player2_id")).alias("player_id")).select("match_id", "player_id", S.oriented_score("player_id", "player2_id", "player1_score", "player2_score").alias("score"))
)

# --- leaderboards ---------------------------------------------------------------------------------

ELO0 = "game_id = 0 and rating_system = 'elo'"
query("l1_top_players", f"select cast(row_number() over (order by value desc, player_id) as int) as position, player_id, name, rating, rd, value, wins, losses, matches_played from (select r.*, n.name, {VALUE} as value from player_ratings r left join players n using (player_id) where game_id = 0 and rating_system = 'glicko2' and matches_played >= 10) x order by value desc, player_id limit 25")(
    lambda t: L.top_players(t.player_ratings, t.players, 0, "glicko2", 25, 10)
)
query("l2_main_game", "select player_id, (select name from games g where g.game_id = x.game_id) as main_game from (select player_id, max_by(game_id, (matches_played, game_id)) as game_id from player_ratings where game_id <> 0 and rating_system = 'elo' group by 1) x")(
    lambda t: L.main_games(t.player_ratings, t.games)
)
FIRST = "(rating, -epoch(played_at), -match_id)"
PEAKS = f"select player_id, game_id, rating_system, max(rating) as peak, max_by(played_at, {FIRST}) as peak_date, max_by(rd, {FIRST}) as peak_rd, max(rating) - case when rating_system = 'glicko2' then max_by(rd, {FIRST}) else 0 end as peak_value from rating_history where matches_played >= {{0}} group by 1, 2, 3"
query("l3_peaks", f"select player_id, game_id, rating_system, peak, {ts('peak_date')}, peak_rd, peak_value from ({PEAKS.format(0)}) p")(lambda t: L.peaks(t.rating_history).select(*L.KEY, "peak", at("peak_date"), "peak_rd", "peak_value"))
query("l4_top_by_peak", f"select p.player_id, p.peak, p.peak_value, r.rating as current from (select * from ({PEAKS.format(10)}) q where game_id = 0 and rating_system = 'glicko2' order by peak_value desc, player_id limit 15) p left join player_ratings r on r.player_id = p.player_id and r.game_id = 0 and r.rating_system = 'glicko2'")(
    lambda t: L.top_by_peak(t.rating_history, t.player_ratings, 0, "glicko2", 15, 10)
)
SNAP = "select player_id, max_by(match_id, (played_at, match_id)) as match_id, max_by(rating, (played_at, match_id)) as rating, max_by(matches_played, (played_at, match_id)) as matches_played from rating_history where {0} and played_at <= timestamp '1996-06-01 00:00:00' group by 1"
query("l5_top_asof", f"select player_id, match_id, rating, rating as value, matches_played from ({SNAP.format(ELO0)}) s where matches_played >= 5 order by rating desc, player_id limit 20")(lambda t: L.top_asof(t.rating_history, "1996-06-01", 0, "elo", 20, 5))
query("l6_count_top", "select game_id, rating_system, count(*) as players from player_ratings where matches_played >= 10 group by 1, 2")(lambda t: L.count_top(t.player_ratings))
query("l7_ratings_for_players", f"select player_id, game_id, {VALUE} as value from player_ratings where rating_system = 'glicko2' and player_id in (select player1_id from matches where game_id = 2 and player1_score = 3)")(
    lambda t: R.exists_in(L.pool(t.player_ratings, None, "glicko2"), t.matches.filter("game_id = 2 and player1_score = 3").withColumnRenamed("player1_id", "player_id"), "player_id").select("player_id", "game_id", L.ranking_value().alias("value"))
)
query("l8_l9_ranks", f"select player_id, game_id, rating_system, value, cast(dense_rank() over (partition by game_id, rating_system order by value desc) as int) as dense_rank, count(*) over (partition by game_id, rating_system) as total from (select *, {VALUE} as value from player_ratings where matches_played >= 10) x")(lambda t: L.ranks(t.player_ratings))
query("l10_most_active", f"select player_id, matches_played from player_ratings where {ELO0} order by matches_played desc, player_id limit 10")(lambda t: L.most_active(t.player_ratings))
query("l11_l12_peak_overall", f"select rating_system, player_id, game_id, match_id, value from (select *, {VALUE} as value, row_number() over (partition by rating_system order by {VALUE} desc, player_id, game_id, match_id) as rn from rating_history where matches_played >= 10) x where rn = 1")(lambda t: L.peak_overall(t.rating_history))
query("l13_top_by_game", "select game_id, player_id, rating as value from (select *, row_number() over (partition by game_id order by rating desc, player_id) as rn from player_ratings where rating_system = 'elo') x where rn <= 3")(lambda t: L.top_by_game(t.player_ratings))
query("l14_both_systems", f"select e.player_id, e.rating as elo, g.rating - g.rd as glicko2 from (select * from player_ratings where {ELO0} and matches_played >= 10 order by rating desc, player_id limit 10) e left join (select * from player_ratings where game_id = 0 and rating_system = 'glicko2' and matches_played >= 10) g using (player_id)")(lambda t: L.both_systems(t.player_ratings))

# --- players --------------------------------------------------------------------------------------

CANON = "select p.player_id, coalesce(a.alias, p.name) as name from players p left join (select player_id, max_by(name, (cnt, name)) as alias from player_aliases group by 1) a using (player_id)"
query("p1_canonical_names", CANON)(lambda t: P.canonical_names(t.players, t.players, t.player_aliases))
query("p2_aliases", f"select a.player_id, a.name, a.cnt, cast(row_number() over (partition by a.player_id order by a.cnt desc, a.name) as int) as position from player_aliases a join ({CANON}) c on a.player_id = c.player_id where a.name <> c.name")(lambda t: P.other_spellings(t.players, t.player_aliases))
query("p3_resolve", "select q.query, min_by(k.player_id, (case when q.query = k.name then p else p + 1 end, k.player_id)) as player_id from (select name as query from players union all select lower(name) from players union all select distinct upper(name) from player_aliases) q join (select player_id, name, 1 as p from players union all select player_id, name, 3 from player_aliases) k on lower(q.query) = lower(k.name) group by 1")(
    lambda t: P.resolve(t.players.select(F.col("name").alias("query")).union(t.players.select(F.lower("name"))).union(t.player_aliases.select(F.upper("name")).distinct()), t.players, t.player_aliases)
)
query("p4_flags", f"select player_id, country, n from (select *, row_number() over (partition by player_id order by n desc, country) as rn from (select player_id, country, count(*) as n from {SIDES} s where country is not null group by 1, 2) x) y where rn = 1")(lambda t: P.common_flags(t.matches))
query("p5_countries", "select player_id, coalesce(country, '') as country from players")(lambda t: t.players.select("player_id", F.coalesce("country", F.lit("")).alias("country")))
query("p6_players_known", f"select player_id from players where player_id in (select player_id from {SIDES} s)")(lambda t: R.exists_in(t.players.select("player_id"), R.participants(t.matches), "player_id"))
query("p7_player_games", f"select distinct s.player_id, g.name from {SIDES} s join games g using (game_id)")(lambda t: P.played_games(t.matches, t.games))
query("p8_player_ratings", f"select r.player_id, r.game_id, r.rating_system, r.rating, p.peak from player_ratings r join ({PEAKS.format(10)}) p using (player_id, game_id, rating_system) where r.matches_played >= 10")(
    lambda t: t.player_ratings.filter("matches_played >= 10").join(L.peaks(t.rating_history.filter("matches_played >= 10")), L.KEY).select(*L.KEY, "rating", "peak")
)
query("p9_history", f"select player_id, match_id, {ts('played_at')}, rating from rating_history where player_id = 7 and {ELO0} order by rating_history.played_at desc, match_id desc limit 40")(
    lambda t: R.page(t.rating_history.filter(f"player_id = 7 and {ELO0}").select("player_id", "match_id", "played_at", "rating"), [F.col("played_at").desc(), F.col("match_id").desc()], 40).select("player_id", "match_id", at("played_at"), "rating")
)
query("p11_monthly", f"select player_id, game_id, match_id, rating from (select *, row_number() over (partition by player_id, game_id, strftime(played_at, '%Y-%m') order by played_at desc, match_id desc) as rn from rating_history where rating_system = 'elo') h where rn = 1")(
    lambda t: P.monthly(t.rating_history.filter("rating_system = 'elo'")).select("player_id", "game_id", "match_id", "rating")
)
OUT = f"(select *, case when winner_id is null then 'D' when winner_id = player_id then 'W' else 'L' end as result from {SIDES} s)"
query("p12_player_matches", f"select match_id, player_id, opponent_id, score || '-' || opponent_score as score, result from {OUT} o where player_id = 5")(
    lambda t: P.outcomes(t.matches.filter("player1_id = 5 or player2_id = 5")).filter("player_id = 5").select("match_id", "player_id", "opponent_id", S.score_text("score", "opponent_score").alias("score"), "result")
)
query("p13_summary", f"select player_id, count(*) as matches, count(*) filter (where result = 'W') as wins, count(*) filter (where result = 'L') as losses, count(*) filter (where result = 'D') as draws, round(count(*) filter (where result = 'W') / count(*), 4) as win_rate, {ts('min(played_at)', 'first_match')}, {ts('max(played_at)', 'last_match')} from {OUT} o group by 1")(
    lambda t: P.summary(t.matches).select("player_id", "matches", "wins", "losses", "draws", num("win_rate"), at("first_match"), at("last_match"))
)
query("p13_extremes", "select player_id, max_by(game_id, (rating, -game_id)) as best_game, min_by(game_id, (rating, game_id)) as worst_game from player_ratings where rating_system = 'elo' and game_id <> 0 group by 1")(lambda t: P.extremes(t.player_ratings))
query("p14_streak", f"with o as (select *, case when result = 'W' then 'W' else 'L' end as r, row_number() over (partition by player_id order by played_at desc, match_id desc, side) as rn from {OUT} x), f as (select *, first_value(r) over (partition by player_id order by rn) as top from o) select player_id, min(top) as result, count(*) as length from (select player_id, top, sum(case when r <> top then 1 else 0 end) over (partition by player_id order by rn) as broken from f) y where broken = 0 group by 1")(
    lambda t: P.streaks(t.matches)
)
DELTA = "(select *, rating - coalesce(lag(rating) over (partition by player_id, game_id, rating_system order by played_at, match_id), 1500.0) as delta from rating_history)"
query("p15_rivals", f"select s.player_id, s.opponent_id, count(*) as matches, count(*) filter (where s.winner_id = s.player_id) as wins, count(*) - count(*) filter (where s.winner_id = s.player_id) as losses, cast(sum(coalesce(d.delta, 0.0)) as double) as delta from {SIDES} s left join (select * from {DELTA} q where {ELO0}) d on d.player_id = s.player_id and d.match_id = s.match_id group by 1, 2")(
    lambda t: P.rivals(t.matches, t.rating_history).select("player_id", "opponent_id", "matches", "wins", "losses", "delta")
)
STAND = "(select tournament_id, game_id, json_extract_string(s, '$.position') as position, cast(json_extract_string(s, '$.player_id') as bigint) as player_id, json_extract_string(s, '$.player_name') as player_name from (select tournament_id, game_id, unnest(from_json(rankings, '[\"json\"]')) as s from tournaments) x)"
query("p16_placements", f"select player_id, game_id, cast(regexp_extract(position, '^(\\d+)', 1) as int) as place, count(*) as n from {STAND} s where player_name <> '' group by 1, 2, 3")(lambda t: P.placements(t.tournaments))
MAPS = f"(select m.name, s.player_id, s.opponent_id, case when s.side = 1 then mm.player1_score > mm.player2_score else mm.player2_score > mm.player1_score end as won from match_maps mm join {SIDES} s using (match_id) join maps m using (map_id) where mm.player1_score <> mm.player2_score)"
EDGES = "select *, wins / (wins + losses) as win_rate, wins / (wins + losses) - sum(wins) over (partition by {0}) / sum(wins + losses) over (partition by {0}) as edge from (select {0}, name, count(*) filter (where won) as wins, count(*) filter (where not won) as losses from {1} x group by all) y"
query("p17_map_edges", f"select player_id, name, wins, losses, round(win_rate, 4) as win_rate, round(edge, 4) as edge from ({EDGES.format('player_id', MAPS)}) z where wins + losses >= 5")(
    lambda t: P.map_edges(t.matches, t.match_maps, t.maps).select("player_id", "name", "wins", "losses", num("win_rate"), num("edge"))
)
query("p18_best_per_system", f"select player_id, rating_system, max_by(game_id, (value, -game_id)) as game_id, max(value) as value from (select *, {VALUE} as value from player_ratings) x group by 1, 2")(lambda t: L.best_per_system(t.player_ratings))
query("p19_autocomplete", "select distinct player_id, name from (select player_id, name from players union all select player_id, name from player_aliases) x where name ilike '%ma%' order by name, player_id limit 30")(lambda t: P.autocomplete(t.players, t.player_aliases, "ma", 30))
query("p20_games", "select g.game_id, g.name, count(m.match_id) as matches, count(m.match_id) > 0 as has_data from games g left join matches m using (game_id) group by 1, 2")(lambda t: P.games_catalogue(t.games, t.matches))

# --- matches --------------------------------------------------------------------------------------

ENRICHED = "(select m.*, a.name as player1, b.name as player2, t.name as tournament, t.tier, g.name as game from matches m left join players a on a.player_id = m.player1_id left join players b on b.player_id = m.player2_id left join tournaments t using (tournament_id) left join games g on g.game_id = m.game_id)"
query("m1_recent_matches", f"select match_id, player1, player2, tournament, tier, game, {ts('played_at')} from {ENRICHED} e where game_id = 2 and tier = 'premier' order by e.played_at desc, match_id desc limit 50 offset 10")(
    lambda t: M.recent(t.matches, t.players, t.tournaments, t.games, 50, 10, game=2, tier="premier").select("match_id", "player1", "player2", "tournament", "tier", "game", at("played_at"))
)
query("m2_count_matches", f"select count(*) as n from {ENRICHED} e where player1 ilike '%#000000001%' or player2 ilike '%#000000001%'")(lambda t: M.selected(t.matches, t.players, t.tournaments, player="#000000001", player_mode="partial").agg(F.count("*").alias("n")))
query("m3_match_details", "select m.match_id, count(mm.map_index) as maps, string_agg(coalesce(x.name, 'Unknown'), ',' order by mm.map_index) as names, count(*) filter (where mm.player1_score > mm.player2_score) as first_won from matches m join match_maps mm using (match_id) left join maps x using (map_id) group by 1")(
    lambda t: M.details(t.matches, t.match_maps, t.maps, t.match_vods).filter("maps is not null").select("match_id", F.size("maps").cast("bigint").alias("maps"), F.array_join(F.transform("maps", lambda m: m["map"]), ",").alias("names"), F.size(F.filter("maps", lambda m: m["won"] == 1)).cast("bigint").alias("first_won"))
)
query("m4_vods", "select match_id, vod_index, vod_post_id from (select *, row_number() over (partition by match_id, platform, video_id order by vod_index) as rn from match_vods) v where rn = 1 or video_id is null")(lambda t: M.vods_once(t.match_vods).select("match_id", "vod_index", "vod_post_id"))
query("m5_map_flags", "select match_id, match_id in (select match_id from match_maps) as has_maps from matches")(
    lambda t: t.matches.select("match_id").join(t.match_maps.select("match_id").distinct().withColumn("h", F.lit(True)), "match_id", "left").select("match_id", F.coalesce("h", F.lit(False)).alias("has_maps"))
)
def rated_pools(t) -> list[tuple[int, str]]:
    """Every game and all of them together, in both systems: a dimension, which costs no pass over the history."""
    return [(g, system) for g in [0, *sorted(r["game_id"] for r in t.games.select("game_id").collect())] for system in ("elo", "glicko2")]


query("m7_ratings_before", f"select s.match_id, s.player_id, h.game_id, h.rating_system, max_by(h.rating, (h.played_at, h.match_id)) as rating from {SIDES} s join rating_history h on h.player_id = s.player_id and h.played_at < s.played_at group by 1, 2, 3, 4")(
    lambda t: M.ratings_before(t.matches, t.rating_history, rated_pools(t)).select("match_id", "player_id", "game_id", "rating_system", "rating")
)
query("m8_k_before", f"select s.match_id, s.player_id, coalesce(max_by(h.matches_played, (h.played_at, h.match_id)), 0) as matches_before from {SIDES} s left join rating_history h on h.player_id = s.player_id and h.game_id = s.game_id and h.rating_system = 'elo' and h.played_at < s.played_at group by 1, 2")(
    lambda t: M.k_factors_before(t.matches, t.rating_history, t.tournaments).select("match_id", "player_id", "matches_before")
)
query("m8_k_factors", f"""select s.match_id, s.player_id, n as matches_before, base as base_k, mult as multiplier, base * mult as k
 from (select match_id, player_id, n, case when n < 30 then 40.0::double when n <= 100 then 24.0::double else 16.0::double end as base, case lower(tier) when 'premier' then 2.0::double when 'major' then 1.5::double else 1.0::double end as mult
 from (select s.match_id, s.player_id, any_value(t.tier) as tier, coalesce(max_by(h.matches_played, (h.played_at, h.match_id)), 0) as n from {SIDES} s left join tournaments t using (tournament_id)
 left join rating_history h on h.player_id = s.player_id and h.game_id = s.game_id and h.rating_system = 'elo' and h.played_at < s.played_at group by 1, 2) x) s""")(
    lambda t: M.k_factors_before(t.matches, t.rating_history, t.tournaments)
)
query("m9_rating_deltas", f"select player_id, game_id, match_id, delta from {DELTA} d where rating_system = 'glicko2'")(lambda t: P.match_deltas(t.rating_history, "glicko2").select("player_id", "game_id", "match_id", "delta"))
H2H = "select least(player1_id, player2_id) as a, greatest(player1_id, player2_id) as b, {0} from matches m {1} group by 1, 2"
query("m10_head_to_head", H2H.format(f"count(*) as matches, count(*) filter (where winner_id = least(player1_id, player2_id)) as a_wins, count(*) filter (where winner_id = greatest(player1_id, player2_id)) as b_wins, count(*) filter (where winner_id is null) as draws, count(distinct game_id) as games, {ts('max(played_at)', 'last_match')}", ""))(
    lambda t: M.head_to_head(t.matches).select("a", "b", "matches", "a_wins", "b_wins", "draws", "games", at("last_match"))
)
query("m11_h2h_deltas", H2H.format("sum(d.delta) filter (where d.player_id = least(player1_id, player2_id)) as a_delta, sum(d.delta) filter (where d.player_id = greatest(player1_id, player2_id)) as b_delta", f"join (select * from {DELTA} q where {ELO0}) d using (match_id)"))(lambda t: M.head_to_head_deltas(t.matches, t.rating_history))
query("m12_h2h_map_edges", f"select player_id, opponent_id, name, wins, losses, round(edge, 4) as edge from ({EDGES.format('player_id, opponent_id', MAPS)}) z")(
    lambda t: P.map_edges(t.matches, t.match_maps, t.maps, 1, True).select("player_id", "opponent_id", "name", "wins", "losses", num("edge"))
)
query("m13_h2h_games", "select distinct least(player1_id, player2_id) as a, greatest(player1_id, player2_id) as b, g.name from matches m join games g using (game_id)")(
    lambda t: t.matches.select(F.least("player1_id", "player2_id").alias("a"), F.greatest("player1_id", "player2_id").alias("b"), "game_id").distinct().join(t.games, "game_id").select("a", "b", "name")
)
query("m14_h2h_rates", H2H.format("round(count(*) filter (where winner_id = least(player1_id, player2_id)) / count(*), 4) as a_rate", ""))(lambda t: M.head_to_head(t.matches).select("a", "b", num(S.win_rate("a_wins", "matches"), 4, "a_rate")))

# --- tournaments, statistics ----------------------------------------------------------------------

query("t1_tournaments", f"select t.tournament_id, t.name, t.tier, {ts('f.first_match')}, {ts('f.last_match')}, coalesce(f.matches, 0) as matches, coalesce(f.players, 0) as players, cast(len(list_distinct(string_split(maplist_csv, ','))) as bigint) as maps from tournaments t left join {TFACT} f using (tournament_id)")(
    lambda t: T.overview(t.tournaments, t.matches).select("tournament_id", "name", "tier", at("first_match"), at("last_match"), "matches", "players", "maps")
)
query("t2_count_tournaments", "select count(*) as n from tournaments where tier = 'premier' and game_id = 2")(lambda t: t.tournaments.filter("tier = 'premier' and game_id = 2").agg(F.count("*").alias("n")))
query("t3_tier_stats", "select t.tier, count(distinct t.tournament_id) as tournaments, count(m.match_id) as matches from tournaments t left join matches m using (tournament_id) group by 1")(lambda t: T.tier_stats(t.tournaments, t.matches))
query("t4_tournament_details", f"select t.tournament_id, t.name, f.matches, f.players from tournaments t join {TFACT} f using (tournament_id)")(lambda t: T.overview(t.tournaments, t.matches).filter("matches > 0").select("tournament_id", "name", "matches", "players"))
SCHED = "(select *, case when tournament_id % 3 = 0 then null else timestamp '2023-12-20 00:00:00' end as schedule_start, case when tournament_id % 3 = 0 then null when tournament_id % 3 = 1 then timestamp '2023-12-31 00:00:00' else timestamp '2024-01-31 00:00:00' end as schedule_end from tournaments)"


def scheduled(t):
    ids = F.col("tournament_id") % 3
    stamp = lambda x: F.lit(x).cast("timestamp")
    return t.tournaments.withColumns({"schedule_start": F.when(ids != 0, stamp("2023-12-20 00:00:00")), "schedule_end": F.when(ids == 1, stamp("2023-12-31 00:00:00")).when(ids == 2, stamp("2024-01-31 00:00:00"))})


NAMED = f"(select tournament_id, bool_and(player_name <> '') as named from {STAND} s group by 1)"
query("t5_status", f"select t.tournament_id, coalesce(schedule_end < timestamp '{NOW}', true) or coalesce(named, false) as over from {SCHED} t left join {NAMED} n using (tournament_id)")(lambda t: T.status(scheduled(t), NOW))
query("t6_in_progress", f"select t.tournament_id, case when named then false when not named then true else coalesce(schedule_start <= timestamp '{NOW}' and schedule_end >= timestamp '{NOW}', false) end as running from {SCHED} t left join {NAMED} n using (tournament_id)")(lambda t: T.in_progress(scheduled(t), NOW))
query("t7_tournament_matches", f"select match_id, player1, player2, {ts('played_at')} from {ENRICHED} e where tournament_id = 11 order by e.played_at desc, match_id desc limit 100")(
    lambda t: M.recent(t.matches.filter("tournament_id = 11"), t.players, t.tournaments, t.games, 100).select("match_id", "player1", "player2", at("played_at"))
)
query("t8_player_stats", f"select a.tournament_id, a.player_id, wins, losses, map_wins, map_losses, frags, deaths from (select tournament_id, player_id, count(*) filter (where winner_id = player_id) as wins, count(*) filter (where winner_id <> player_id) as losses from {SIDES} s where tournament_id is not null group by 1, 2) a left join (select tournament_id, player_id, count(*) filter (where mine > theirs) as map_wins, count(*) filter (where mine < theirs) as map_losses, cast(sum(mine) as bigint) as frags, cast(sum(theirs) as bigint) as deaths from (select s.tournament_id, s.player_id, case when side = 1 then mm.player1_score else mm.player2_score end as mine, case when side = 1 then mm.player2_score else mm.player1_score end as theirs from {SIDES} s join match_maps mm using (match_id) where tournament_id is not null) x group by 1, 2) b using (tournament_id, player_id)")(
    lambda t: T.player_stats(t.matches, t.match_maps).select("tournament_id", "player_id", "wins", "losses", "map_wins", "map_losses", "frags", "deaths")
)
query("t9_rating_deltas", f"select tournament_id, player_id, rating_system, max_by(rating, (h.played_at, h.match_id)) - coalesce(max_by(rating, (h.played_at, h.match_id)) filter (where h.played_at < lo), min_by(rating, (h.played_at, h.match_id)) filter (where h.played_at >= lo)) as delta from (select distinct tournament_id, player_id from {SIDES} s where tournament_id is not null) p join (select tournament_id, min(played_at) as lo, max(played_at) as hi from matches group by 1) w using (tournament_id) join (select * from rating_history where game_id = 0) h using (player_id) where h.played_at <= hi group by 1, 2, 3")(
    lambda t: in_portions(t, T.rating_deltas(t.tournaments, t.matches, t.rating_history).select("tournament_id", "player_id", "rating_system", "delta"))
)
query("t10_played_maps", "select m.tournament_id, mm.map_id, count(*) as times, coalesce(x.name, 'Unknown') as name from matches m join match_maps mm using (match_id) left join maps x on x.map_id = mm.map_id where m.tournament_id is not null and mm.map_id is not null group by 1, 2, 4")(lambda t: T.played_maps(t.matches, t.match_maps, t.maps))
query("t11_maplist", "select t.tournament_id, array_to_string(list_distinct_ordered || coalesce(extra, []), ',') as maplist from (select tournament_id, [x for x, i in string_split(maplist_csv, ',') if list_position(string_split(maplist_csv, ','), x) = i] as list_distinct_ordered, string_split(maplist_csv, ',') as l from tournaments) t left join (select m.tournament_id, list(distinct coalesce(x.name, 'Unknown') order by coalesce(x.name, 'Unknown')) as extra from matches m join match_maps mm using (match_id) left join maps x on x.map_id = mm.map_id where mm.map_id is not null group by 1) e using (tournament_id)")(
    lambda t: T.completed_maplist(t.tournaments, T.played_maps(t.matches, t.match_maps, t.maps)).select("tournament_id", F.array_join("maplist", ",").alias("maplist"))
)
query(
    "t12_standings",
    f"""with delta as (
  select tournament_id, player_id, rating_system, after - coalesce(prior, first) as delta from (
   select c.tournament_id, c.player_id, h.rating_system, max_by(h.rating, (h.played_at, h.match_id)) filter (where h.played_at <= c.hi) as after,
    max_by(h.rating, (h.played_at, h.match_id)) filter (where h.played_at < c.lo) as prior, min_by(h.rating, (h.played_at, h.match_id)) filter (where h.played_at <= c.hi) as first
   from (select distinct s.tournament_id, s.player_id, lo, hi from {SIDES} s join (select tournament_id, min(played_at) as lo, max(played_at) as hi from matches where tournament_id is not null group by 1) x using (tournament_id)) c
   join rating_history h on h.player_id = c.player_id and h.game_id = 0 group by 1, 2, 3) y where after is not null),
 record as (select tournament_id, player_id, count(*) filter (where winner_id = player_id) as wins, count(*) filter (where winner_id is not null and winner_id <> player_id) as losses from {SIDES} q where tournament_id is not null group by 1, 2),
 seats as (select s.tournament_id, s.position, s.player_id, p.country, not exists (select 1 from {SIDES} k where k.player_id = s.player_id) as unknown, w.wins, w.losses,
   case when s.player_name <> '' then round(e.delta, 4) end as elo_delta, case when s.player_name <> '' then round(g.delta, 4) end as glicko2_delta
  from {STAND} s left join players p using (player_id) left join record w on w.tournament_id = s.tournament_id and w.player_id = s.player_id
  left join delta e on e.tournament_id = s.tournament_id and e.player_id = s.player_id and e.rating_system = 'elo' left join delta g on g.tournament_id = s.tournament_id and g.player_id = s.player_id and g.rating_system = 'glicko2')
 select *, coalesce(bool_or(coalesce(wins, 0) <> 0 or coalesce(losses, 0) <> 0) over (partition by tournament_id), false) as has_matches from seats""",
)(
    lambda t: in_portions(
        t,
        T.enriched_standings(t.tournaments, t.players, T.player_stats(t.matches, t.match_maps), T.rating_deltas(t.tournaments, t.matches, t.rating_history), R.participants(t.matches)).select(
            "tournament_id", "position", "player_id", "country", "unknown", "wins", "losses", num("elo_delta"), num("glicko2_delta"), "has_matches"
        ),
    )
)
query("t13_winners", f"select tournament_id, player_id, count(*) as matches, count(*) filter (where winner_id = player_id) as wins from {SIDES} s where tournament_id is not null group by 1, 2")(lambda t: T.winners(t.matches))
query("x1_stats", f"select count(distinct match_id) as matches, count(distinct player_id) as players, count(distinct tournament_id) as tournaments, count(distinct country) as countries, count(distinct player_id) filter (where played_at >= timestamp '1998-07-01 00:00:00' - interval 30 day) as active, {ts('min(played_at)', 'first_match')}, {ts('max(played_at)', 'last_match')} from {SIDES} s")(
    lambda t: T.stats(t.matches, "1998-07-01 00:00:00").select("matches", "players", "tournaments", "countries", "active", at("first_match"), at("last_match"))
)
query("x1_game_stats", f"select s.game_id, g.name, count(distinct match_id) as matches, count(distinct tournament_id) as tournaments, count(distinct player_id) as players from {SIDES} s join games g using (game_id) group by 1, 2")(lambda t: T.game_stats(t.matches, t.games))
query("x2_map_names", "select distinct mm.map_id, coalesce(m.name, '') as name from match_maps mm left join maps m using (map_id) where mm.map_id is not null")(
    lambda t: t.match_maps.filter("map_id is not null").select("map_id").distinct().join(t.maps, "map_id", "left").select("map_id", F.coalesce("name", F.lit("")).alias("name"))
)
query("x3_post_counts", "select count(*) filter (where status = 'parsed') as parsed, count(*) as total from raw_posts")(lambda t: t.raw_posts.agg(F.count_if(F.col("status") == "parsed").alias("parsed"), F.count("*").alias("total")))

# --- ratings --------------------------------------------------------------------------------------

query("g1_rating_input", f"select match_id, pool, cast({RESULT} as double) as result from matches cross join lateral (select unnest([0, game_id]) as pool) p where {DUEL}")(lambda t: G.rating_input(t.matches).select("match_id", "pool", "result"))
query("g2_counters", f"select pool, match_id, player_id, cast(sum(case when r = 1 then 1 else 0 end) over w as bigint) as wins, cast(sum(case when r = 0 then 1 else 0 end) over w as bigint) as losses, count(*) over w as matches_played from (select s.match_id, s.player_id, s.side, s.played_at, p.pool, case when s.side = 1 then m.r else 1 - m.r end as r from {SIDES} s join (select match_id, {RESULT} as r from matches) m using (match_id) cross join lateral (select unnest([0, s.game_id]) as pool) p where {DUEL}) x window w as (partition by pool, player_id order by played_at, match_id, side rows between unbounded preceding and current row)")(
    lambda t: G.counters(G.rating_input(t.matches)).select("pool", "match_id", "player_id", "wins", "losses", "matches_played")
)
query("g2_elo")(lambda t: G.elo(t.matches, t.tournaments).select("player_id", "game_id", "match_id", num("rating"), "wins", "losses", "matches_played"))


@query("g4_glicko2")
def _(t):
    return G.glicko2(t.matches, "month", keep=stored).select("player_id", "game_id", "n", "match_id", num("rating"), num("rd"), num("vol", 6), "wins", "losses", "matches_played")


query("g5_idle_rd", "select player_id, game_id, round(least(350.0, sqrt(pow(rd, 2) + (player_id % 9) * pow(173.7178 * vol, 2))), 4) as rd from player_ratings where rating_system = 'glicko2'")(
    lambda t: t.player_ratings.filter("rating_system = 'glicko2'").select("player_id", "game_id", num(G.idle_rd("rd", "vol", F.col("player_id") % 9), 4, "rd"))
)
query("g7_match_state", f"with m as (select pool, min(match_id) as lo, max(match_id) as hi, count(distinct match_id) as n from matches cross join lateral (select unnest([0, game_id]) as pool) p where {DUEL} group by 1), h as (select game_id as pool, min(match_id) as lo, max(match_id) as hi, count(distinct match_id) as n from rating_history where rating_system = 'elo' and (game_id <> 3 or match_id < 9000) group by 1) select m.pool, m.n as matches, coalesce(h.n, 0) as rated, case when h.n is null then 'backfill' when m.n = h.n and m.lo = h.lo and m.hi = h.hi then 'up_to_date' when m.hi > h.hi and m.lo = h.lo then 'new_matches' else 'backfill' end as state from m left join h using (pool)")(
    lambda t: G.match_state(t.matches, t.rating_history.filter("game_id <> 3 or match_id < 9000"))
)
query("g8_late_matches", "select min(played_at) < timestamp '1995-03-01 00:00:00' as late from matches where match_id > 7000")(lambda t: G.late_matches(t.matches.filter("match_id > 7000"), "1995-03-01 00:00:00"))
query("g9_corrupt", "select game_id, rating_system, count(*) filter (where rating < 0 or rating > 10000 or isnan(rating)) as bad from rating_history group by 1, 2")(lambda t: t.rating_history.groupBy("game_id", "rating_system").agg(F.count_if(G.corrupt()).alias("bad")))
query("g10_delete_from", "select game_id, rating_system, count(*) as n from rating_history where not (game_id = 2 and rating_system = 'elo' and played_at >= timestamp '1996-01-01 00:00:00') group by 1, 2")(
    lambda t: G.delete_from(t.rating_history, 2, "elo", "1996-01-01 00:00:00").groupBy("game_id", "rating_system").agg(F.count("*").alias("n"))
)
query("g11_current_ratings", f"select player_id, game_id, rating_system, rating, wins, losses, last_match_id, {ts('first_match_date')} from player_ratings")(lambda t: G.current_ratings(t.rating_history).select(*L.KEY, "rating", "wins", "losses", "last_match_id", at("first_match_date")))
query("g13_names_filled", f"select player_id, coalesce(name, 'player_' || cast(player_id as varchar)) as name from (select distinct player_id from {SIDES} s) x left join (select * from players where player_id % 5 <> 0) p using (player_id)")(
    lambda t: P.canonical_names(G.players_in(t.matches), t.players.filter("player_id % 5 <> 0"), t.player_aliases.filter("false"))
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten by Elo with canonical names, rated from the matches themselves."""
    t = Tables(spark, sf_dir)
    ratings = G.current_ratings(G.elo(t.matches, t.tournaments))
    return L.top_players(ratings, P.canonical_names(t.players, t.players, t.player_aliases), 0, "elo", 10, 1)


query("step0_top_by_elo")(lambda t: flagship(t.spark, t.dir).withColumns({"rating": F.round("rating", 4), "value": F.round("value", 4)}))

# --- extraction -----------------------------------------------------------------------------------

from rankforge.sources import extract as E  # noqa: E402
from rankforge.streaming import streams as ST  # noqa: E402

query("e1_classify_pages", "select page_id, case when html is null or trim(html) = '' then 'invalid' when not contains(html, '<div class=\"match\">') then 'not a match' else 'parse error' end as kind from pages")(
    lambda t: t.base("pages").select("page_id", E.page_class(F.col("html")).alias("kind"))
)
query("e5_decide_winner", "select match_id, case when marker = 1 then player1_id when marker = 2 then player2_id when player1_score > player2_score then player1_id when player2_score > player1_score then player2_id end as winner, case when player1_score = player2_score and marker > 0 then 2 - marker else player1_score end as s1, case when player1_score = player2_score and marker > 0 then marker - 1 else player2_score end as s2 from (select *, cast(match_id % 3 as int) as marker from matches) m")(
    lambda t: t.matches.select("match_id", *[c.cast(k).alias(n) for c, n, k in zip(E.decide_winner((F.col("match_id") % 3).cast("int"), F.col("player1_id"), F.col("player2_id"), F.col("player1_score"), F.col("player2_score")), ("winner", "s1", "s2"), ("bigint", "int", "int"))])
)
query("e9_attach_embeds", "select v.match_id, v.vod_index, coalesce(e.video_id, v.video_id) as video_id from (select match_id, vod_index, vod_post_id, case when vod_post_id % 2 = 0 then video_id end as video_id from match_vods) v left join (select vod_post_id, 'x' || cast(vod_post_id as varchar) as video_id from match_vods where vod_post_id % 5 = 0) e using (vod_post_id)")(
    lambda t: E.attach_embeds(t.match_vods.withColumn("video_id", F.when(F.col("vod_post_id") % 2 == 0, F.col("video_id"))), t.match_vods.filter("vod_post_id % 5 = 0").select("vod_post_id", F.lit("youtube").alias("platform"), F.concat(F.lit("x"), F.col("vod_post_id").cast("string")).alias("video_id")))[0].select("match_id", "vod_index", "video_id")
)
query("e14_register", "select match_id as post_id, strftime(min(played_at), '%Y-%m-%d %H:%M:%S') as sort_time from matches where match_id not in (select post_id from raw_posts where status <> 'discovered') group by 1")(
    lambda t: E.register(t.matches.select("match_id", "played_at"), t.raw_posts.filter("status <> 'discovered'")).select("post_id", at("sort_time"))
)
query("e15_progress", "select *, coalesce(max(case when full_run = 3 then 1 else 0 end) over (order by page rows between unbounded preceding and current row) = 1, false) as caught_up from (select *, sum(case when new = 0 then 1 else 0 end) over (order by page rows between 2 preceding and current row) as full_run from (select match_id // 100 as page, count(*) filter (where p.post_id is null) as new, count(*) filter (where p.post_id is not null) as known from matches m left join (select post_id from raw_posts where post_id < 100 or post_id % 2 = 0) p on p.post_id = m.match_id group by 1) x) y".replace("select *, coalesce(", "select page, new, known, coalesce("))(
    lambda t: E.progress(t.matches.select(F.expr("match_id div 100").alias("page"), "match_id"), t.raw_posts.filter("post_id < 100 or post_id % 2 = 0"))
)
query("e16_due", "select post_id from raw_posts where status = 'skipped' and reason = 'not played' and sort_time <= timestamp '2024-02-15 00:00:00'")(lambda t: E.due(t.raw_posts, F.lit("2024-02-15 00:00:00").cast("timestamp")).select("post_id"))
query("e17_walls", "select min(id) as first_id, max(id) as last_id, count(*) as length from (select id, id - row_number() over (order by id) as island from (select match_id as id from matches where match_id % 17 > 4) a) b group by island having count(*) >= 10")(
    lambda t: E.walls(t.matches.filter("match_id % 17 > 4").select(F.col("match_id").alias("post_id"), F.lit("skipped").alias("status"), F.lit("invalid").alias("reason")), 10)
)
query("e18_pending_vods", "select distinct vod_post_id as post_id from match_vods where vod_post_id not in (select post_id from raw_posts)")(lambda t: E.pending_vods(t.match_vods, t.raw_posts))
query("e22_needs_bracket", "select t.tournament_id, 'egb' as source from tournaments t left join (select tournament_id, case when tournament_id % 4 = 0 then 0 else 5 end as matches, timestamp '2024-01-01 00:00:00' - to_days(cast(tournament_id % 6 as int)) as fetched_at from tournaments where tournament_id % 3 = 0) s using (tournament_id) where s.matches is null or s.matches = 0 or s.fetched_at < timestamp '2024-01-01 00:00:00' - interval 3 day")(
    lambda t: E.needs_bracket(t.tournaments.select("tournament_id", F.lit("egb").alias("source")), t.tournaments.filter("tournament_id % 3 = 0").select("tournament_id", F.when(F.col("tournament_id") % 4 == 0, 0).otherwise(5).alias("matches"), (F.lit(NOW).cast("timestamp") - F.make_interval(days=(F.col("tournament_id") % 6).cast("int"))).alias("fetched_at")), F.lit(NOW).cast("timestamp"), 3)
)


def named_matches(t):
    return R.with_names(t.matches, t.players).select("match_id", "played_at", "player1_id", "player2_id", F.col("player1").alias("player1_name"), F.concat(F.col("player2"), (F.col("match_id") % 3).cast("string")).alias("player2_name"), "player1_country", "player2_country")


NAMED_SIDES = "(select match_id, played_at, player1_id as player_id, a.name as name, player1_country as country from matches m join players a on a.player_id = player1_id union all select match_id, played_at, player2_id, b.name || cast(match_id % 3 as varchar), player2_country from matches m join players b on b.player_id = player2_id)"
query("e23_players_upsert", f"select player_id, max_by(name, (played_at, match_id)) as name, max_by(country, (played_at, match_id)) filter (where country is not null) as country from {NAMED_SIDES} s group by 1")(lambda t: E.dimension_players(named_matches(t)))
query("e24_alias_counts", f"select player_id, name, count(*) as cnt from {NAMED_SIDES} s group by 1, 2")(lambda t: E.alias_counts(named_matches(t)))
query("e25_parse_summary", "select status, reason, count(*) as n from raw_posts group by 1, 2")(lambda t: E.parse_summary(t.raw_posts))

# --- streams, drained -----------------------------------------------------------------------------

CLOSED = "(select max(ts) - interval 1 day from events)"
query("s4_tumbling_counts", f"select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events where date_trunc('day', ts) + interval 1 day <= {CLOSED} group by 1, 2")(
    lambda t: ST.drained(ST.tumbling_counts(ST.events(t.spark, t.dir), "ts", "event_type")).select(at("window_start"), "event_type", "n")
)
query("s2_dedup", "select event_id, user_id from events")(
    lambda t: ST.drained(ST.dedup(ST.events(t.spark, t.dir).select("event_id", "ts", "user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")), "ts", ["event_id"])).select("event_id", "user_id")
)
S5 = "(select user_id as key, event_id as id, ts, case event_type when 'click' then 'W' when 'view' then 'L' else 'D' end as result from events)"
query("s5_running_records", f"select key, id, count(*) over w as matches, cast(sum(case when result = 'W' then 1 else 0 end) over w as bigint) as wins, cast(sum(case when result = 'L' then 1 else 0 end) over w as bigint) as losses from {S5} e window w as (partition by key order by ts, id rows between unbounded preceding and current row)")(
    lambda t: ST.drained(ST.running_records(ST.events(t.spark, t.dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "click", "W").when(F.col("event_type") == "view", "L").otherwise("D").alias("result")))).select("key", "id", "matches", "wins", "losses")
)
