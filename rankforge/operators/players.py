"""Player operators; each takes the tables of all players, a single player is a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.scalars import is_duel, ordinal_rank, period_start, win_rate
from rankforge.operators.relational import asof_forward, page, participants, previous, top_by

STANDINGS = "array<struct<position:string,player_id:bigint,player_name:string,prize:string,game:string,game_category_id:int>>"


def canonical_names(ids: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """Most used spelling, else the player's name, else player_<id>."""
    best = aliases.groupBy("player_id").agg(F.max_by("name", F.struct("cnt", "name")).alias("alias"))
    out = ids.select("player_id").join(best, "player_id", "left").join(players.select("player_id", "name"), "player_id", "left")
    return out.select("player_id", F.coalesce("alias", "name", F.concat(F.lit("player_"), F.col("player_id").cast("string"))).alias("name"))


def other_spellings(players: DataFrame, aliases: DataFrame) -> DataFrame:
    known = canonical_names(players, players, aliases).withColumnRenamed("name", "canonical")
    rows = aliases.join(known, "player_id").filter("name <> canonical")
    order = Window.partitionBy("player_id").orderBy(F.col("cnt").desc(), "name")
    return rows.select("player_id", "name", "cnt", F.row_number().over(order).alias("position"))


def resolve(queries: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """The player a name means: exact name, then any case, then exact alias, then alias in any case."""
    known = players.select("player_id", "name", F.lit(1).alias("p")).union(aliases.select("player_id", "name", F.lit(3).alias("p")))
    hit = queries.join(known.withColumn("low", F.lower("name")), F.lower("query") == F.col("low"))
    hit = hit.withColumn("p", F.when(F.col("query") == F.col("name"), F.col("p")).otherwise(F.col("p") + 1))
    return hit.groupBy("query").agg(F.min_by("player_id", F.struct("p", "player_id")).alias("player_id"))


def flag_counts(matches: DataFrame) -> DataFrame:
    return participants(matches).filter("country is not null").groupBy("player_id", "country").agg(F.count("*").alias("n"))


def common_flags(matches: DataFrame) -> DataFrame:
    return top_by(flag_counts(matches), ["player_id"], [F.col("n").desc(), F.col("country").asc()], 1).select("player_id", "country", "n")


def played_games(matches: DataFrame, games: DataFrame) -> DataFrame:
    return participants(matches).select("player_id", "game_id").distinct().join(games, "game_id").select("player_id", "name")


def history_both(history: DataFrame, unit: str = "month") -> DataFrame:
    """Elo snapshots with the last glicko2 rating at or before their period."""
    elo, other = history.filter("rating_system = 'elo'"), history.filter("rating_system = 'glicko2'")
    return asof_forward(elo, other, ["player_id", "game_id"], period_start("played_at", unit), "match_id", "rating")


def monthly(history: DataFrame) -> DataFrame:
    """The last snapshot of each month."""
    rows = history.withColumn("month", F.date_format("played_at", "yyyy-MM"))
    by = ["player_id", "game_id", "rating_system", "month"]
    return top_by(rows, by, [F.col("played_at").desc(), F.col("match_id").desc()], 1)


def outcomes(matches: DataFrame) -> DataFrame:
    """Participants with their result: W, L or D."""
    won = F.when(F.col("winner_id").isNull(), "D").when(F.col("winner_id") == F.col("player_id"), "W").otherwise("L")
    return participants(matches).withColumn("result", won)


def summary(matches: DataFrame) -> DataFrame:
    """Totals of every player: matches, wins, losses, draws, win rate, first and last match."""
    rows = outcomes(matches)
    n = lambda r: F.count_if(F.col("result") == r)
    out = rows.groupBy("player_id").agg(F.count("*").alias("matches"), n("W").alias("wins"), n("L").alias("losses"), n("D").alias("draws"), F.min("played_at").alias("first_match"), F.max("played_at").alias("last_match"))
    return out.withColumn("win_rate", win_rate("wins", "matches"))


def extremes(ratings: DataFrame) -> DataFrame:
    """Each player's best and worst game by Elo."""
    rows = ratings.filter("rating_system = 'elo' and game_id <> 0")
    return rows.groupBy("player_id").agg(F.max_by("game_id", F.struct("rating", -F.col("game_id"))).alias("best_game"), F.min_by("game_id", F.struct("rating", "game_id")).alias("worst_game"))


def streaks(matches: DataFrame, draw_as: str = "L") -> DataFrame:
    """The run of equal results up to each player's newest match."""
    rows = outcomes(matches).withColumn("r", F.when(F.col("result") == "D", draw_as).otherwise(F.col("result")))
    newest = Window.partitionBy("player_id").orderBy(F.col("played_at").desc(), F.col("match_id").desc(), "side")
    rows = rows.withColumn("changed", F.when(F.col("r") != F.lag("r").over(newest), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("changed").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("island = 0").groupBy("player_id").agg(F.first("r").alias("result"), F.count("*").alias("length"))


def match_deltas(history: DataFrame, system: str = "elo", game: int | None = None) -> DataFrame:
    """The change of each snapshot against the one before; debuts start at 1500."""
    rows = history.filter(F.col("rating_system") == system)
    if game is not None:
        rows = rows.filter(F.col("game_id") == game)
    return previous(rows).withColumn("delta", F.col("rating") - F.col("previous"))


def rivals(matches: DataFrame, history: DataFrame) -> DataFrame:
    """Per pair of players: matches, wins, losses and the sum of the player's Elo changes over all games."""
    sides = participants(matches)
    deltas = match_deltas(history, "elo", 0).select("player_id", "match_id", "delta")
    rows = sides.join(deltas, ["player_id", "match_id"], "left")
    out = rows.groupBy("player_id", "opponent_id").agg(F.count("*").alias("matches"), F.count_if(F.col("winner_id") == F.col("player_id")).alias("wins"), F.sum(F.coalesce("delta", F.lit(0.0))).alias("delta"), F.min("played_at").alias("first_match"), F.max("played_at").alias("last_match"))
    return out.withColumn("losses", F.col("matches") - F.col("wins"))


def standings(tournaments: DataFrame) -> DataFrame:
    rows = tournaments.withColumn("s", F.explode(F.from_json("rankings", STANDINGS)))
    return rows.select("tournament_id", "game_id", "s.position", "s.player_id", "s.player_name")


def placements(tournaments: DataFrame) -> DataFrame:
    rows = standings(tournaments).filter("player_name <> ''").withColumn("place", ordinal_rank("position"))
    return rows.filter("place > 0").groupBy("player_id", "game_id", "place").agg(F.count("*").alias("n"))


def map_edges(matches: DataFrame, match_maps: DataFrame, maps: DataFrame, min_games: int = 5, versus: bool = False) -> DataFrame:
    """Per player (and opponent) and map name: wins and losses by map score, and the win rate over the player's own.

    Drawn maps do not count; the overall rate is over all maps, before min_games.
    """
    rows = match_maps.select("match_id", "map_id", F.col("player1_score").alias("m1"), F.col("player2_score").alias("m2")).filter("m1 <> m2")
    rows = rows.join(matches.select("match_id", "player1_id", "player2_id"), "match_id").join(maps.select("map_id", "name"), "map_id")
    sides = F.array(F.struct(F.col("player1_id").alias("player_id"), F.col("player2_id").alias("opponent_id"), (F.col("m1") > F.col("m2")).alias("won")), F.struct(F.col("player2_id").alias("player_id"), F.col("player1_id").alias("opponent_id"), (F.col("m2") > F.col("m1")).alias("won")))
    rows = rows.select("name", F.explode(sides).alias("p")).select("name", "p.*")
    by = ["player_id", "opponent_id"] if versus else ["player_id"]
    per = rows.groupBy(*by, "name").agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"))
    w = Window.partitionBy(*by)
    rate = F.col("wins") / (F.col("wins") + F.col("losses"))
    per = per.withColumn("win_rate", rate).withColumn("edge", rate - F.sum("wins").over(w) / F.sum(F.col("wins") + F.col("losses")).over(w))
    return per.filter(F.col("wins") + F.col("losses") >= min_games)


def autocomplete(players: DataFrame, aliases: DataFrame, query: str, limit: int = 10) -> DataFrame:
    rows = players.select("player_id", "name").union(aliases.select("player_id", "name")).distinct()
    return page(rows.filter(F.lower("name").contains(query.lower())), [F.col("name").asc(), F.col("player_id").asc()], limit)


def games_catalogue(games: DataFrame, matches: DataFrame) -> DataFrame:
    played = matches.groupBy("game_id").agg(F.count("*").alias("matches"))
    return games.join(played, "game_id", "left").select("game_id", "name", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), F.col("matches").isNotNull().alias("has_data"))


def duels(matches: DataFrame) -> DataFrame:
    return matches.filter(is_duel("match_format"))
