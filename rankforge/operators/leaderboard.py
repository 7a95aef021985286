"""Leaderboards, peaks and ranks over rating tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.scalars import conservative
from rankforge.operators.relational import last_by, page, top_by

KEY = ["player_id", "game_id", "rating_system"]


def ranking_value(system: str = "rating_system") -> Column:
    """What a leaderboard is ordered by: the rating, less its deviation for glicko2."""
    return F.when(F.col(system) == "glicko2", conservative("rating", "rd")).otherwise(F.col("rating"))


def pool(df: DataFrame, game: int | None, system: str | None, min_matches: int = 0) -> DataFrame:
    if game is not None:
        df = df.filter(F.col("game_id") == game)
    if system is not None:
        df = df.filter(F.col("rating_system") == system)
    return df.filter(F.col("matches_played") >= min_matches) if min_matches else df


def peaks(history: DataFrame) -> DataFrame:
    """Per player, pool and system: the highest rating, when it was first reached and the deviation there.

    peak_value of glicko2 is the highest rating less the deviation at that moment.
    """
    first = F.struct(F.col("rating"), -F.unix_timestamp("played_at"), -F.col("match_id"))
    out = history.groupBy(*KEY).agg(F.max("rating").alias("peak"), F.max_by("played_at", first).alias("peak_date"), F.max_by("rd", first).alias("peak_rd"))
    return out.withColumn("peak_value", F.when(F.col("rating_system") == "glicko2", F.col("peak") - F.coalesce("peak_rd", F.lit(0.0))).otherwise(F.col("peak")))


def main_games(ratings: DataFrame, games: DataFrame) -> DataFrame:
    """Each player's game of most matches; ties to the larger game id."""
    own = ratings.filter("game_id <> 0 and rating_system = 'elo'").groupBy("player_id").agg(F.max_by("game_id", F.struct("matches_played", "game_id")).alias("game_id"))
    return own.join(games, "game_id", "left").select("player_id", F.col("name").alias("main_game"))


def top_players(ratings: DataFrame, names: DataFrame, game: int = 0, system: str = "elo", limit: int = 10, min_matches: int = 10, offset: int = 0) -> DataFrame:
    """A page of the leaderboard with positions and names; names are joined after the page is cut."""
    rows = pool(ratings, game, system, min_matches).withColumn("value", ranking_value())
    rows = page(rows, [F.col("value").desc(), F.col("player_id").asc()], limit, offset)
    w = Window.orderBy(F.col("value").desc(), F.col("player_id").asc())  # of one page
    rows = rows.withColumn("position", (F.row_number().over(w) + offset).cast("int"))
    return rows.join(names.select("player_id", "name"), "player_id", "left").select("position", "player_id", "name", "rating", "rd", "value", "wins", "losses", "matches_played")


def top_by_peak(history: DataFrame, ratings: DataFrame, game: int = 0, system: str = "elo", limit: int = 10, min_matches: int = 10) -> DataFrame:
    """Highest peaks among snapshots of players with enough matches by then, with the current rating if any."""
    best = peaks(pool(history, game, system, min_matches))
    best = page(best, [F.col("peak_value").desc(), F.col("player_id").asc()], limit)
    return best.join(ratings.select(*KEY, F.col("rating").alias("current")), KEY, "left").select("player_id", "peak", "peak_value", "current")


def snapshot_asof(history: DataFrame, date: str, game: int = 0, system: str = "elo", min_matches: int = 0) -> DataFrame:
    """The last snapshot of each player at or before midnight of a date."""
    rows = last_by(pool(history, game, system).filter(F.col("played_at") <= F.lit(date).cast("timestamp")), KEY)
    return rows.filter(F.col("matches_played") >= min_matches).withColumn("value", ranking_value())


def top_asof(history: DataFrame, date: str, game: int = 0, system: str = "elo", limit: int = 10, min_matches: int = 0) -> DataFrame:
    rows = snapshot_asof(history, date, game, system, min_matches)
    return page(rows, [F.col("value").desc(), F.col("player_id").asc()], limit).select("player_id", "match_id", "rating", "value", "matches_played")


def count_top(ratings: DataFrame, min_matches: int = 10) -> DataFrame:
    return ratings.filter(F.col("matches_played") >= min_matches).groupBy("game_id", "rating_system").agg(F.count("*").alias("players"))


def ranks(ratings: DataFrame, min_matches: int = 10) -> DataFrame:
    """Dense rank of every qualifying player in every pool and system, and how many qualify.

    Players are ranked within bands of one rating point, so that a pool is dealt over many tasks; a band's ranks
    begin after the distinct values of the bands above, of which a pool has a few thousand. Nulls come last.
    """
    band = F.when(F.isnan("value"), F.lit(1 << 62)).otherwise(F.coalesce(F.floor("value"), F.lit(-1 << 62)))
    rows = ratings.filter(F.col("matches_played") >= min_matches).withColumn("value", ranking_value()).withColumn("band", band)
    inside = Window.partitionBy("game_id", "rating_system", "band").orderBy(F.col("value").desc())
    rows = rows.select(*KEY, "value", "band", F.dense_rank().over(inside).alias("place"))
    pool = Window.partitionBy("game_id", "rating_system")
    above = pool.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("game_id", "rating_system", "band").agg(F.max("place").alias("values"), F.count("*").alias("n"))
    bands = bands.select("game_id", "rating_system", "band", F.coalesce(F.sum("values").over(above), F.lit(0)).alias("before"), F.sum("n").over(pool).alias("total"))
    return rows.join(bands, ["game_id", "rating_system", "band"]).select(*KEY, "value", (F.col("before") + F.col("place")).cast("int").alias("dense_rank"), "total")


def most_active(ratings: DataFrame, limit: int = 10) -> DataFrame:
    return page(pool(ratings, 0, "elo"), [F.col("matches_played").desc(), F.col("player_id").asc()], limit).select("player_id", "matches_played")


def peak_overall(history: DataFrame, min_matches: int = 10) -> DataFrame:
    """The single best moment of each system over all games: for glicko2 the highest rating less deviation.

    This is not the peak of `peaks`, which takes the deviation at the highest rating.
    """
    rows = history.filter(F.col("matches_played") >= min_matches).withColumn("value", ranking_value())
    best = rows.groupBy("rating_system").agg(F.max_by(F.struct("player_id", "game_id", "match_id", "value"), F.struct("value", -F.col("player_id"), -F.col("game_id"), -F.col("match_id"))).alias("b"))
    return best.select("rating_system", "b.*")


def top_by_game(ratings: DataFrame, system: str = "elo", n: int = 3) -> DataFrame:
    rows = pool(ratings, None, system).withColumn("value", ranking_value())
    return top_by(rows, ["game_id"], [F.col("value").desc(), F.col("player_id").asc()], n).select("game_id", "player_id", "value")


def both_systems(ratings: DataFrame, game: int = 0, limit: int = 10, min_matches: int = 10) -> DataFrame:
    """The top by Elo, with the glicko2 value of those who qualify there."""
    elo = page(pool(ratings, game, "elo", min_matches), [F.col("rating").desc(), F.col("player_id").asc()], limit).select("player_id", F.col("rating").alias("elo"))
    other = pool(ratings, game, "glicko2", min_matches).select("player_id", ranking_value().alias("glicko2"))
    return elo.join(other, "player_id", "left")


def best_per_system(ratings: DataFrame) -> DataFrame:
    """Each player's best pool in each system."""
    rows = ratings.withColumn("value", ranking_value())
    best = rows.groupBy("player_id", "rating_system").agg(F.max_by(F.struct("game_id", "value"), F.struct("value", -F.col("game_id"))).alias("b"))
    return best.select("player_id", "rating_system", "b.*")
