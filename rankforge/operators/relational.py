"""Relational building blocks of the query layer, as functions from DataFrames to a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def latest_by_key(df: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """One row a key, that of the last version. version must order the rows of a key fully."""
    order = [F.col(v).desc() if isinstance(v, str) else v for v in version]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def text_match(col: str, pattern: str, mode: str = "exact") -> Column:
    """exact: equal; partial: contains, whatever the case; regex: found, whatever the case."""
    if mode == "exact":
        return F.col(col) == pattern
    if mode == "partial":
        escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return F.col(col).ilike(f"%{escaped}%")
    return F.col(col).rlike(f"(?i){pattern}")


def match_modes(queries: DataFrame, names: DataFrame, col: str = "name") -> DataFrame:
    """queries (q, ...) with mode: regex if q holds a sign of patterns, exact if it is one of names, else partial."""
    known = names.select(F.col(col).alias("q"), F.lit(True).alias("_known")).distinct()
    signs = F.rlike("q", F.lit(r"[\^$*+?|()\[\]{}\\]"))
    return queries.join(known, "q", "left").withColumn("mode", F.when(signs, "regex").when(F.col("_known"), "exact").otherwise("partial")).drop("_known")


def smart_match_mode(names: DataFrame, col: str, query: str) -> str:
    """regex if the query has its marks, exact if it is a known name, else partial."""
    if any(ch in r"^$*+?|()[]{}\\" for ch in query):
        return "regex"
    return "exact" if names.filter(F.col(col) == query).limit(1).count() else "partial"


def with_names(matches: DataFrame, players: DataFrame) -> DataFrame:
    """player1 and player2 by name; unknown players keep their matches."""
    one = players.select(F.col("player_id").alias("player1_id"), F.col("name").alias("player1"))
    two = players.select(F.col("player_id").alias("player2_id"), F.col("name").alias("player2"))
    return matches.join(one, "player1_id", "left").join(two, "player2_id", "left")


def exists_in(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    return df.join(facts.select(key), key, "left_semi")


def not_in(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], period: Column, tie: str, value: str) -> DataFrame:
    """left with the last value of right at or before its period in the same group.

    Both sides are stacked, right first within a period, and the last value is carried on: one shuffle by the
    group and no range join.
    """
    w = Window.partitionBy(*by).orderBy("_period", "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    a = right.select(*by, period.alias("_period"), F.lit(0).alias("_side"), F.col(tie), F.col(value).alias("_v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    b = left.select(*by, period.alias("_period"), F.lit(1).alias("_side"), F.col(tie), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct("*").alias("_row"))
    return a.unionByName(b).withColumn("_f", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select("_row.*", F.col("_f").alias(f"asof_{value}"))


def before(history: DataFrame, at: Column, by: Sequence[str]) -> DataFrame:
    """The last snapshot of each group strictly before a fixed time."""
    return last_by(history.filter(F.col("played_at") < at), by)


def last_by(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """The last snapshot of each group by (played_at, match_id), by one aggregation."""
    rest = [x for x in history.columns if x not in by]
    out = history.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("played_at", "match_id")).alias("_s"))
    return out.select(*by, "_s.*")


def participants(matches: DataFrame) -> DataFrame:
    """A row for each side of each match, from one scan."""
    side = lambda a, b, n: F.struct(F.col(f"player{a}_id").alias("player_id"), F.col(f"player{b}_id").alias("opponent_id"), F.col(f"player{a}_score").alias("score"), F.col(f"player{b}_score").alias("opponent_score"), F.col(f"player{a}_country").alias("country"), F.lit(n).alias("side"))
    keep = ["match_id", "winner_id", "game_id", "tournament_id", "match_format", "played_at"]
    return matches.select(*keep, F.explode(F.array(side(1, 2, 1), side(2, 1, 2))).alias("_p")).select(*keep, "_p.*")


def top_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a full order; Spark keeps only the first offset + limit rows of each task."""
    return df.orderBy(*order).offset(offset).limit(limit)


def previous(history: DataFrame, start: float = 1500.0) -> DataFrame:
    """history with previous: the rating before in the same series, start at a debut."""
    w = Window.partitionBy("player_id", "game_id", "rating_system").orderBy("played_at", "match_id")
    return history.withColumn("previous", F.coalesce(F.lag("rating").over(w), F.lit(start)))


def or_initial(df: DataFrame, state: DataFrame, key: Sequence[str], initial: dict[str, float]) -> DataFrame:
    """df with the state of its keys; keys without one have the initial values."""
    out = df.join(state, list(key), "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in initial.items()})


def tier_rank(tier: str = "tier") -> Column:
    return F.when(F.col(tier) == "premier", 0).when(F.col(tier) == "major", 1).when(F.col(tier) == "minor", 2)


def tier_order(descending: bool = True) -> list[Column]:
    """premier first when descending; tournaments without a tier come last either way."""
    r = tier_rank()
    return [r.isNull().asc(), r.asc() if descending else r.desc()]


def directed(col: Column, descending: bool) -> Column:
    return col.desc_nulls_last() if descending else col.asc_nulls_last()


def player_order(col: str, descending: bool = True) -> list[Column]:
    """The order of a leaderboard by one of its columns; nulls last, then the player."""
    by = {"win_rate": F.try_divide("wins", "matches_played"), "name": F.lower("name"), "main_game": F.lower("main_game"), "matches": F.col("matches_played")}
    return [directed(by.get(col, F.col(col) if col not in by else None), descending), F.col("player_id").asc()]


def tournament_order(col: str, descending: bool = True) -> list[Column]:
    first = tier_order(descending) if col == "tier" else [directed(F.lower(col) if col in ("name", "game") else F.col(col), descending)]
    return [*first, F.col("tournament_id").asc()]


def match_order(col: str = "played_at", descending: bool = True) -> list[Column]:
    """A score is ordered by its sum, then by the first player's part."""
    if col == "score":
        first = [directed(F.col("player1_score") + F.col("player2_score"), descending), directed(F.col("player1_score"), descending)]
    elif col == "tier":
        first = tier_order(descending)
    else:
        first = [directed(F.lower(col) if col in ("player1", "player2", "tournament", "game") else F.col(col), descending)]
    return [*first, F.col("match_id").desc() if descending else F.col("match_id").asc()]


def widths(df: DataFrame, columns: Sequence[str], chars: bool = False) -> DataFrame:
    """The longest value of each displayed column, in bytes or in characters."""
    size = F.char_length if chars else F.octet_length
    return df.agg(*[F.coalesce(F.max(size(F.col(x).cast("string"))), F.lit(0)).cast("bigint").alias(x) for x in columns])
