"""The match data model as DataFrames: a projection of the given star-schema tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("supplier", "orders", "lineitem", "part", "customer", "events", "pages")

#: The projection, in SQL that Spark and DuckDB both run; each view may use those above it.
VIEWS = {
    "players": "select cast(s_suppkey + 1 as bigint) as player_id, s_name as name, concat('n', cast(s_nationkey as varchar(9))) as country from supplier",
    "games": "select distinct cast(substr(o_orderpriority,1,1) as int) as game_id, substr(o_orderpriority,3) as name from orders",
    "matches": """select match_id, player1_id, player2_id, player1_score, player2_score,
  case when player1_score > player2_score then player1_id when player2_score > player1_score then player2_id when o_orderstatus = 'O' then player1_id end as winner_id,
  game_id, match_format, tournament_id, stage_name, played_at,
  case when c % 10 < 7 then concat('n', cast(player1_id % 25 as varchar(9))) when c % 10 < 9 then concat('n', cast((player1_id + 1) % 25 as varchar(9))) end as player1_country,
  case when c % 9 < 7 then concat('n', cast(player2_id % 25 as varchar(9))) end as player2_country
from (
  select o_orderkey as match_id, o_orderstatus, c,
    cast(o_custkey % s + 1 as bigint) as player1_id,
    cast((o_custkey % s + 1 + o_orderkey % (s - 1)) % s + 1 as bigint) as player2_id,
    cast(c % 4 as int) as player1_score, cast(cast(floor(c / 4) as bigint) % 4 as int) as player2_score,
    cast(substr(o_orderpriority,1,1) as int) as game_id,
    case when c % 11 = 0 then 'Team Duel' when c % 7 = 0 then 'Time Limit Duel' when c % 5 = 0 then 'TDM 4v4' else '1v1 Best of 3' end as match_format,
    case when c % 13 = 0 then null else cast(o_orderkey % t + 1 as bigint) end as tournament_id,
    concat('Round ', cast(c % 6 + 1 as varchar(9))) as stage_name,
    cast(o_orderdate as timestamp) as played_at
  from (select *, cast(round(o_totalprice * 100) as bigint) as c from orders) o
  cross join (select count(*) as s from supplier) x cross join (select count(*) as t from part) y) z""",
    "match_maps_raw": """select l_orderkey as match_id, l_linenumber as map_index, nullif(cast(l_partkey % 64 as int), 0) as map_id,
  cast(l_quantity as int) % 21 - 1 as player1_score, cast(l_partkey % 21 as int) as player2_score,
  cast(l_shipdate as timestamp) as version_ts, l_partkey as version_k1, l_suppkey as version_k2
from lineitem""",
    "match_maps": """select match_id, map_index, map_id, player1_score, player2_score from (
  select *, row_number() over (partition by match_id, map_index order by version_ts desc, version_k1 desc, version_k2 desc, map_id desc, player1_score desc) as rn from match_maps_raw) v where rn = 1""",
    "maps": "select distinct cast(p_partkey % 64 as int) as map_id, concat('map', cast(p_partkey % 48 % 64 as varchar(9))) as name from part where p_partkey % 64 <> 0 and p_partkey < 64",
    "tournaments": """select cast(p_partkey + 1 as bigint) as tournament_id, concat(p_name, ' ', cast(p_partkey as varchar(9))) as name,
  case p_type when 'PROMO' then 'premier' when 'LARGE' then 'major' when 'STANDARD' then null else 'minor' end as tier,
  cast(p_partkey % 5 + 1 as int) as game_id, concat(p_brand, ',', p_type, ',', p_brand) as maplist_csv,
  concat('[{"position":"1st","player_id":', cast(p_partkey % 10 + 1 as varchar(9)), ',"player_name":"A"},{"position":"2nd","player_id":', cast(p_partkey % 7 + 1 as varchar(9)), ',"player_name":"', case when p_size % 3 = 0 then '' else 'B' end, '"}]') as rankings
from part""",
    "player_aliases": "select cast(c_custkey % s + 1 as bigint) as player_id, c_mktsegment as name, count(*) as cnt from customer cross join (select count(*) as s from supplier) x group by 1, 2",
    "rating_history": """select player_id, game_id, rating_system, match_id, played_at,
  cast(1500.0 + 8 * (wins - losses) + ((match_id * 7919 + player_id * 104729 + game_id) % 997) * 0.125 + case when rating_system = 'glicko2' then 25 else 0 end as double) as rating,
  cast(case when rating_system = 'glicko2' then case when matches_played > 60 then 50 else 350 - 5 * matches_played end else 0 end as double) as rd,
  cast(case when rating_system = 'glicko2' then 0.0625 else 0.0 end as double) as vol,
  cast(wins as bigint) as wins, cast(losses as bigint) as losses, cast(matches_played as bigint) as matches_played
from (
  select p.*, y.rating_system,
    row_number() over (partition by player_id, game_id, rating_system, date_trunc('month', played_at) order by played_at desc, match_id desc) as rn
  from (
    select player_id, game_id, match_id, played_at,
      sum(win) over (partition by player_id, game_id order by played_at, match_id rows between unbounded preceding and current row) as wins,
      sum(loss) over (partition by player_id, game_id order by played_at, match_id rows between unbounded preceding and current row) as losses,
      row_number() over (partition by player_id, game_id order by played_at, match_id) as matches_played
    from (
      select player_id, g as game_id, match_id, played_at, case when winner_id = player_id then 1 else 0 end as win, case when winner_id <> player_id then 1 else 0 end as loss
      from (select player1_id as player_id, winner_id, game_id, match_id, played_at, match_format from matches union all select player2_id, winner_id, game_id, match_id, played_at, match_format from matches) a
      cross join (select 0 as z union all select 1) b
      cross join lateral (select case when z = 0 then 0 else game_id end as g) l
      where (lower(match_format) like '%duel%' and lower(match_format) not like '%team%') or lower(match_format) like '%1v1%') e) p
  cross join (select 'elo' as rating_system union all select 'glicko2') y) q
where rating_system = 'elo' or rn = 1""",
    "player_ratings": """select player_id, game_id, rating_system, rating, rd, vol, wins, losses, matches_played, match_id as last_match_id, played_at as last_match_date, first_match_date from (
  select *, row_number() over (partition by player_id, game_id, rating_system order by played_at desc, match_id desc) as rn,
    min(played_at) over (partition by player_id, game_id, rating_system) as first_match_date from rating_history) h where rn = 1""",
    "match_vods": """select cast(event_id % 101 as bigint) as match_id, cast(row_number() over (partition by event_id % 101 order by event_id) - 1 as int) as vod_index, event_id as vod_post_id,
  case event_type when 'click' then 'youtube' when 'view' then 'twitch' when 'purchase' then 'vimeo' end as platform,
  case when event_type in ('click','view','purchase') then concat('v', cast(user_id % 7 as varchar(9))) end as video_id
from events where event_id % 3 <> 0""",
    "raw_posts": """select page_id as post_id, html as raw_html,
  case page_id % 4 when 0 then 'discovered' when 1 then 'downloaded' when 2 then 'parsed' else 'skipped' end as status,
  case when page_id % 4 = 3 then case page_id % 3 when 0 then 'not played' when 1 then 'team format' else 'not a match' end end as reason,
  timestamp '2024-01-01 00:00:00' + interval '1' day * (page_id * 37 % 100) as sort_time
from pages""",
}


def needed(sql: str, names: dict[str, str]) -> list[str]:
    """The views that a query uses, directly or through others, in order."""
    import re

    found: set[str] = set()

    def visit(text: str) -> None:
        for name in names:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                visit(names[name])

    visit(sql)
    return [n for n in names if n in found]


def with_views(sql: str) -> str:
    """A query with the views that it uses in front, for an engine that knows the given tables by name."""
    names = needed(sql, VIEWS)
    if not names:
        return sql
    recursive = "recursive " if sql.lstrip().lower().startswith("with recursive") else ""
    body = sql.lstrip()
    own = ""
    if body.lower().startswith("with "):
        body = body[len("with recursive ") :] if recursive else body[len("with ") :]
        own = ", "
    return f"with {recursive}" + ", ".join(f"{n} as ({VIEWS[n]})" for n in names) + (own + body if own else " " + body)


class Tables:
    """Lazy DataFrames of the data model over one directory of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sources = {b: f"select * from parquet.`{self.dir}/{b}.parquet`" for b in BASE}
        names = sources | VIEWS
        used = needed(VIEWS[name], names)
        head = ", ".join(f"{n} as ({names[n]})" for n in [*used, name])
        return self.spark.sql(f"with {head} select * from {name}")

    players = cached_property(lambda self: self.view("players"))
    games = cached_property(lambda self: self.view("games"))
    matches = cached_property(lambda self: self.view("matches"))
    match_maps_raw = cached_property(lambda self: self.view("match_maps_raw"))
    match_maps = cached_property(lambda self: self.view("match_maps"))
    maps = cached_property(lambda self: self.view("maps"))
    tournaments = cached_property(lambda self: self.view("tournaments"))
    player_aliases = cached_property(lambda self: self.view("player_aliases"))
    rating_history = cached_property(lambda self: self.view("rating_history"))
    player_ratings = cached_property(lambda self: self.view("player_ratings"))
    match_vods = cached_property(lambda self: self.view("match_vods"))
    raw_posts = cached_property(lambda self: self.view("raw_posts"))
