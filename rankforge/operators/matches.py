"""Matches, head to head, rating changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.scalars import base_k, tier_multiplier, winner_name
from rankforge.operators.players import match_deltas
from rankforge.operators.relational import last_by, match_order, page, text_match, with_names


def selected(matches: DataFrame, players: DataFrame, tournaments: DataFrame, player: str | None = None, player_mode: str = "exact", game: int | None = None, tier: str | None = None, tournament: str | None = None, tournament_mode: str = "partial", since: str | None = None) -> DataFrame:
    """Matches that pass all filters; a player filter takes either side.

    Names and tiers are filtered in their own tables, of which only the ids meet the matches.
    """
    rows = matches
    if game is not None:
        rows = rows.filter(F.col("game_id") == game)
    if since is not None:
        rows = rows.filter(F.col("played_at") >= F.lit(since).cast("timestamp"))
    if tier is not None or tournament is not None:
        fit = tournaments if tier is None else tournaments.filter(F.col("tier") == tier)
        fit = fit if tournament is None else fit.filter(text_match("name", tournament, tournament_mode))
        rows = rows.join(fit.select("tournament_id"), "tournament_id", "left_semi")
    if player is not None:
        ids = players.filter(text_match("name", player, player_mode)).select("player_id").distinct()
        for n in (1, 2):
            rows = rows.join(ids.select(F.col("player_id").alias(f"player{n}_id"), F.lit(True).alias(f"_{n}")), f"player{n}_id", "left")
        rows = rows.filter(F.col("_1") | F.col("_2")).select(*matches.columns)
    return rows


def named(rows: DataFrame, players: DataFrame, tournaments: DataFrame, games: DataFrame) -> DataFrame:
    """Matches with the names of their players, tournament and game, the tier and the winner's name."""
    rows = with_names(rows, players).join(tournaments.select("tournament_id", F.col("name").alias("tournament"), "tier"), "tournament_id", "left")
    rows = rows.join(games.select("game_id", F.col("name").alias("game")), "game_id", "left")
    return rows.withColumn("winner", winner_name("player1_id", "player2_id", "winner_id", "player1", "player2"))


def filtered(matches: DataFrame, players: DataFrame, tournaments: DataFrame, games: DataFrame, **filters) -> DataFrame:
    """Matches with names that pass all filters of `selected`."""
    return named(selected(matches, players, tournaments, **filters), players, tournaments, games)


def recent(matches: DataFrame, players: DataFrame, tournaments: DataFrame, games: DataFrame, limit: int = 20, offset: int = 0, sort: str = "played_at", descending: bool = True, **filters) -> DataFrame:
    """A page of the matches that pass all filters, with names, which are joined after the page is cut unless it is sorted by them."""
    rows = selected(matches, players, tournaments, **filters)
    if sort in matches.columns or sort == "score":
        return named(page(rows, match_order(sort, descending), limit, offset), players, tournaments, games)
    return page(named(rows, players, tournaments, games), match_order(sort, descending), limit, offset)


def vods_once(vods: DataFrame) -> DataFrame:
    """Vods in order without later rows of the same video in a match; rows without a video stay."""
    first = Window.partitionBy("match_id", "platform", "video_id").orderBy("vod_index")
    rows = vods.withColumn("_rn", F.when(F.coalesce("video_id", F.lit("")) != "", F.row_number().over(first)).otherwise(1))
    return rows.filter("_rn = 1").drop("_rn")


def details(matches: DataFrame, match_maps: DataFrame, maps: DataFrame, vods: DataFrame) -> DataFrame:
    """Matches with their maps, each with its winner, and their vods, as ordered arrays."""
    named = match_maps.join(maps.select("map_id", F.col("name").alias("map")), "map_id", "left")
    side = F.when(F.col("player1_score") > F.col("player2_score"), 1).when(F.col("player2_score") > F.col("player1_score"), 2).otherwise(0)
    own = named.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("map_index", F.coalesce("map", F.lit("Unknown")).alias("map"), "player1_score", "player2_score", side.alias("won")))).alias("maps"))
    seen = vods_once(vods).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("vod_index", "vod_post_id", "platform", "video_id"))).alias("vods"))
    return matches.join(own, "match_id", "left").join(seen, "match_id", "left")


def ratings_before(matches: DataFrame, history: DataFrame, pools: list[tuple[int, str]] | None = None) -> DataFrame:
    """Per match, side, pool and system: the player's last snapshot strictly before the match's time.

    pools: the (game_id, rating_system) asked for; all that history has, if not given.

    Matches and snapshots are stacked by player, snapshots of an instant after the matches of that instant, and one
    window carries the last snapshot of every pool and system at once, so that no match is repeated for them. Pools are
    few: the games and all of them together.
    """
    sides = matches.select("match_id", "played_at", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
    if pools is None:
        pools = sorted((r[0], r[1]) for r in history.select("game_id", "rating_system").distinct().collect())
    shape = "struct<rating:double,rd:double,matches_played:bigint>"
    asked = sides.select("player_id", "played_at", F.lit(0).alias("s"), F.col("match_id").alias("asked"), F.lit(None).cast("bigint").alias("m"), F.lit(None).cast("int").alias("game_id"), F.lit(None).cast("string").alias("rating_system"), F.lit(None).cast(shape).alias("v"))
    known = history.select("player_id", "played_at", F.lit(1).alias("s"), F.lit(None).cast("bigint").alias("asked"), F.col("match_id").alias("m"), F.col("game_id").cast("int"), "rating_system", F.struct("rating", "rd", F.col("matches_played").cast("bigint").alias("matches_played")).alias("v"))
    w = Window.partitionBy("player_id").orderBy("played_at", "s", "m").rowsBetween(Window.unboundedPreceding, 0)
    own = lambda g, system: F.when((F.col("game_id") == g) & (F.col("rating_system") == system), F.col("v"))
    rows = asked.unionByName(known).withColumns({f"_{i}": F.last(own(g, system), ignorenulls=True).over(w) for i, (g, system) in enumerate(pools)}).filter("asked is not null")
    last = F.array(*[F.struct(F.lit(g).cast("int").alias("game_id"), F.lit(system).alias("rating_system"), F.col(f"_{i}").alias("v")) for i, (g, system) in enumerate(pools)])
    if not pools:
        return sides.limit(0).select("match_id", "player_id", F.lit(0).alias("game_id"), F.lit("").alias("rating_system"), F.lit(0.0).alias("rating"), F.lit(0.0).alias("rd"), F.lit(0).cast("bigint").alias("matches_played"))
    return rows.select(F.col("asked").alias("match_id"), "player_id", F.explode(last).alias("x")).filter("x.v is not null").select("match_id", "player_id", "x.game_id", "x.rating_system", "x.v.*")


def k_factors_before(matches: DataFrame, history: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Per match and side in the match's own game: matches before, base K, tier multiplier and K."""
    elo = ratings_before(matches, history.filter("rating_system = 'elo' and game_id <> 0"))
    sides = matches.select("match_id", "game_id", "tournament_id", F.explode(F.array("player1_id", "player2_id")).alias("player_id"))
    rows = sides.join(elo.select("match_id", "player_id", "game_id", "matches_played"), ["match_id", "player_id", "game_id"], "left")
    rows = rows.join(tournaments.select("tournament_id", "tier"), "tournament_id", "left").withColumn("n", F.coalesce("matches_played", F.lit(0)).cast("bigint"))
    return rows.select("match_id", "player_id", F.col("n").alias("matches_before"), base_k("n").alias("base_k"), tier_multiplier(F.coalesce("tier", F.lit(""))).alias("multiplier"), (base_k("n") * tier_multiplier(F.coalesce("tier", F.lit("")))).alias("k"))


def head_to_head(rows: DataFrame) -> DataFrame:
    """All pairs that met, smaller id first: matches, wins of both sides and draws."""
    pair = rows.select(F.least("player1_id", "player2_id").alias("a"), F.greatest("player1_id", "player2_id").alias("b"), "winner_id", "game_id", "match_id", "played_at")
    return pair.groupBy("a", "b").agg(F.count("*").alias("matches"), F.count_if(F.col("winner_id") == F.col("a")).alias("a_wins"), F.count_if(F.col("winner_id") == F.col("b")).alias("b_wins"), F.count_if(F.col("winner_id").isNull()).alias("draws"), F.count_distinct("game_id").alias("games"), F.max("played_at").alias("last_match"))


def head_to_head_deltas(matches: DataFrame, history: DataFrame) -> DataFrame:
    """Sum of each side's Elo changes over all mutual matches of a pair."""
    deltas = match_deltas(history, "elo", 0).select("player_id", "match_id", "delta")
    pair = matches.select("match_id", F.least("player1_id", "player2_id").alias("a"), F.greatest("player1_id", "player2_id").alias("b"))
    rows = pair.join(deltas, "match_id")
    return rows.groupBy("a", "b").agg(F.sum(F.when(F.col("player_id") == F.col("a"), F.col("delta"))).alias("a_delta"), F.sum(F.when(F.col("player_id") == F.col("b"), F.col("delta"))).alias("b_delta"))


def last_snapshots(history: DataFrame) -> DataFrame:
    return last_by(history, ["player_id", "game_id", "rating_system"])
