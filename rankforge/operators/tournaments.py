"""Tournaments, standings, map pools, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.operators.players import standings
from rankforge.operators.relational import last_by, participants

SYSTEMS = ("elo", "glicko2")


def overview(tournaments: DataFrame, matches: DataFrame) -> DataFrame:
    """Per tournament: first and last match, matches, distinct players, distinct maps of its list."""
    sides = participants(matches).filter("tournament_id is not null")
    facts = sides.groupBy("tournament_id").agg(F.min("played_at").alias("first_match"), F.max("played_at").alias("last_match"), F.count_if(F.col("side") == 1).alias("matches"), F.count_distinct("player_id").alias("players"))
    out = tournaments.join(facts, "tournament_id", "left")
    return out.select("tournament_id", "name", "tier", "game_id", "first_match", "last_match", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), F.coalesce("players", F.lit(0)).cast("bigint").alias("players"), F.size(F.array_distinct(F.split("maplist_csv", ","))).cast("bigint").alias("maps"))


def tier_stats(tournaments: DataFrame, matches: DataFrame) -> DataFrame:
    rows = tournaments.select("tournament_id", "tier").join(matches.select("tournament_id", "match_id"), "tournament_id", "left")
    return rows.groupBy("tier").agg(F.count_distinct("tournament_id").alias("tournaments"), F.count("match_id").alias("matches"))


def status(tournaments: DataFrame, now: str, end: str = "schedule_end") -> DataFrame:
    """over: the schedule has ended (an unknown end counts as ended), or every standing has a name."""
    named = standings(tournaments).groupBy("tournament_id").agg(F.bool_and(F.col("player_name") != "").alias("named"))
    ended = F.coalesce(F.col(end) < F.lit(now).cast("timestamp"), F.lit(True))
    return tournaments.join(named, "tournament_id", "left").select("tournament_id", (ended | F.coalesce("named", F.lit(False))).alias("over"))


def in_progress(tournaments: DataFrame, now: str, start: str = "schedule_start", end: str = "schedule_end") -> DataFrame:
    """Whether to look again: complete standings say no, partial ones yes, and without any the schedule decides."""
    named = standings(tournaments).groupBy("tournament_id").agg(F.bool_and(F.col("player_name") != "").alias("named"))
    at = F.lit(now).cast("timestamp")
    by_time = F.coalesce((F.col(start) <= at) & (F.col(end) >= at), F.lit(False))
    return tournaments.join(named, "tournament_id", "left").select("tournament_id", F.when(F.col("named"), False).when(~F.col("named"), True).otherwise(by_time).alias("running"))


def player_stats(matches: DataFrame, match_maps: DataFrame) -> DataFrame:
    """Per tournament and player: matches won and lost, maps won and lost, frags and deaths (null without maps)."""
    sides = participants(matches).filter("tournament_id is not null")
    per_match = sides.groupBy("tournament_id", "player_id").agg(F.count_if(F.col("winner_id") == F.col("player_id")).alias("wins"), F.count_if(F.col("winner_id") != F.col("player_id")).alias("losses"))
    maps = match_maps.select("match_id", F.col("player1_score").alias("m1"), F.col("player2_score").alias("m2"))
    rows = sides.select("match_id", "tournament_id", "player_id", "side").join(maps, "match_id")
    mine, theirs = F.when(F.col("side") == 1, F.col("m1")).otherwise(F.col("m2")), F.when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    per_map = rows.groupBy("tournament_id", "player_id").agg(F.count_if(mine > theirs).alias("map_wins"), F.count_if(mine < theirs).alias("map_losses"), F.sum(mine).alias("frags"), F.sum(theirs).alias("deaths"))
    return per_match.join(per_map, ["tournament_id", "player_id"], "left")


def rating_deltas(tournaments: DataFrame, matches: DataFrame, history: DataFrame, game: int = 0) -> DataFrame:
    """Per tournament player and system: the last snapshot in its time less the last before it.

    Without an earlier snapshot the change is against first_in, then the player's first of all. Snapshots and the
    beginnings and ends of tournaments are stacked by player: a beginning comes before the snapshots of its
    instant, an end after them, and each takes the last snapshot so far.
    """
    sides = participants(matches).filter("tournament_id is not null")
    span = sides.groupBy("tournament_id").agg(F.min("played_at").alias("lo"), F.max("played_at").alias("hi"))
    own = sides.select("tournament_id", "player_id").distinct().join(span, "tournament_id")
    moment = lambda col, place: F.struct(F.col(col).alias("played_at"), F.lit(place).alias("place"))
    asked = own.select("player_id", "tournament_id", F.explode(F.array(moment("lo", 0), moment("hi", 2))).alias("m"), F.explode(F.array(*map(F.lit, SYSTEMS))).alias("rating_system"))
    asked = asked.select("player_id", "rating_system", "m.*", "tournament_id")
    known = history.filter(F.col("game_id") == game).select("player_id", "rating_system", "played_at", F.lit(1).alias("place"), "match_id", "rating")
    so_far = Window.partitionBy("player_id", "rating_system").orderBy("played_at", "place", "match_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(known, allowMissingColumns=True)
    rows = rows.withColumns({"last": F.last("rating", ignorenulls=True).over(so_far), "first": F.first("rating", ignorenulls=True).over(so_far)})
    at_end = lambda col: F.max(F.when(F.col("place") == 2, F.col(col)))
    out = rows.filter("tournament_id is not null").groupBy("player_id", "rating_system", "tournament_id").agg(at_end("last").alias("after"), F.max(F.when(F.col("place") == 0, F.col("last"))).alias("prior"), at_end("first").alias("first"))
    out = out.filter("after is not null").withColumn("first_in", F.when(F.col("prior").isNull(), F.col("first"))).drop("first")
    return out.withColumn("delta", F.col("after") - F.coalesce("prior", "first_in"))


def played_maps(matches: DataFrame, match_maps: DataFrame, maps: DataFrame) -> DataFrame:
    """The maps played in each tournament, by id, with names."""
    rows = matches.filter("tournament_id is not null").select("match_id", "tournament_id").join(match_maps.filter("map_id is not null").select("match_id", "map_id"), "match_id")
    out = rows.groupBy("tournament_id", "map_id").agg(F.count("*").alias("times"))
    return out.join(maps.select("map_id", "name"), "map_id", "left").select("tournament_id", "map_id", "times", F.coalesce("name", F.lit("Unknown")).alias("name"))


def completed_maplist(tournaments: DataFrame, played: DataFrame) -> DataFrame:
    """The listed maps in order, then played ones that are not listed."""
    names = played.groupBy("tournament_id").agg(F.array_sort(F.collect_set("name")).alias("own"))
    listed = F.array_distinct(F.split("maplist_csv", ","))
    out = tournaments.join(names, "tournament_id", "left")
    return out.select("tournament_id", F.concat(listed, F.coalesce(F.array_except("own", listed), F.array().cast("array<string>"))).alias("maplist"))


def tournament_maps(listed: DataFrame, played: DataFrame, maps: DataFrame) -> DataFrame:
    """(tournament_id, place, map_id, name, image): the maps on a tournament's page in order, then played ones by id.

    listed: (tournament_id, place, map_id, name, image); played: (tournament_id, map_id); maps: (map_id, name, image).
    A name is the page's, else that of maps, else 'Unknown'; an image is that of maps, else the page's.
    """
    page = listed.groupBy("tournament_id", "map_id").agg(F.min_by(F.struct("name", "image"), "place").alias("page"), F.min("place").alias("at"))
    both = page.join(played.select("tournament_id", "map_id").distinct(), ["tournament_id", "map_id"], "full")
    named = both.join(maps.select("map_id", F.col("name").alias("_name"), F.col("image").alias("_image")), "map_id", "left")
    order = Window.partitionBy("tournament_id").orderBy(F.col("at").asc_nulls_last(), "map_id")
    return named.select("tournament_id", F.row_number().over(order).alias("place"), "map_id", F.coalesce("page.name", "_name", F.lit("Unknown")).alias("name"), F.coalesce("_image", "page.image").alias("image"))


def map_images(asked: DataFrame, maps: DataFrame, by: str = "map_id") -> DataFrame:
    """asked with the image of each map by id or by name, empty if there is none; a name of several maps takes the smallest id."""
    known = maps.filter("image is not null and image <> ''")
    known = known.groupBy("name").agg(F.min_by("image", "map_id").alias("image")) if by == "name" else known.select("map_id", "image")
    return asked.join(known, by, "left").withColumn("image", F.coalesce("image", F.lit("")))


def enriched_standings(tournaments: DataFrame, players: DataFrame, stats: DataFrame, deltas: DataFrame, known: DataFrame) -> DataFrame:
    """Standings with country, unknown mark, record, both rating changes there, and which columns have data.

    known: player_id of players with matches; others are unknown. Seats without a name have no rating change; seats
    without matches there have no record. has_matches, has_maps and has_frags tell whether any seat of the
    tournament has such figures.
    """
    change = lambda system: F.max(F.when(F.col("rating_system") == system, F.col("delta"))).alias(f"{system}_delta")
    both = deltas.groupBy("tournament_id", "player_id").agg(change("elo"), change("glicko2"))
    rows = standings(tournaments).join(players.select("player_id", "country"), "player_id", "left")
    rows = rows.join(known.select("player_id", F.lit(False).alias("unknown")).distinct(), "player_id", "left").withColumn("unknown", F.coalesce("unknown", F.lit(True)))
    rows = rows.join(stats.select("tournament_id", "player_id", "wins", "losses", "map_wins", "map_losses", "frags", "deaths"), ["tournament_id", "player_id"], "left").join(both, ["tournament_id", "player_id"], "left")
    named = F.coalesce(F.col("player_name") != "", F.lit(False))
    rows = rows.withColumns({c: F.when(named, F.col(c)) for c in ("elo_delta", "glicko2_delta")})
    own = Window.partitionBy("tournament_id")
    some = lambda a, b: F.coalesce(F.max((F.coalesce(F.col(a), F.lit(0)) != 0) | (F.coalesce(F.col(b), F.lit(0)) != 0)).over(own), F.lit(False))
    return rows.withColumns({"has_matches": some("wins", "losses"), "has_maps": some("map_wins", "map_losses"), "has_frags": some("frags", "deaths")})


def winners(matches: DataFrame) -> DataFrame:
    rows = participants(matches).filter("tournament_id is not null")
    return rows.groupBy("tournament_id", "player_id").agg(F.count("*").alias("matches"), F.count_if(F.col("winner_id") == F.col("player_id")).alias("wins"))


def last_before(history: DataFrame, time: str) -> DataFrame:
    return last_by(history.filter(F.col("played_at") < F.lit(time).cast("timestamp")), ["player_id", "game_id", "rating_system"])


def game_stats(matches: DataFrame, games: DataFrame) -> DataFrame:
    """Per game: matches, tournaments and players."""
    rows = participants(matches)
    out = rows.groupBy("game_id").agg(F.count_distinct("match_id").alias("matches"), F.count_distinct("tournament_id").alias("tournaments"), F.count_distinct("player_id").alias("players"))
    return out.join(games, "game_id").select("game_id", "name", "matches", "tournaments", "players")


def stats(matches: DataFrame, now: str, days: int = 30) -> DataFrame:
    """One row of totals; active players are those of the last days before now."""
    rows = participants(matches)
    recent = F.col("played_at") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    out = rows.agg(F.count_if(F.col("side") == 1).alias("matches"), F.count_distinct("player_id").alias("players"), F.count_distinct("tournament_id").alias("tournaments"), F.count_distinct("country").alias("countries"), F.count_distinct(F.when(recent, F.col("player_id"))).alias("active"), F.min("played_at").alias("first_match"), F.max("played_at").alias("last_match"))
    return out.withColumn("average", F.col("matches") * 2 / F.col("players"))
