"""Brackets as a long table: tournament_id, stage_no, group_no, round_no, match_no, group, p1, p2, score1, score2, winner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NORMAL = "struct<source:string,title:string,complete:boolean,stages:array<struct<name:string,groups:array<struct<name:string,rounds:array<struct<name:string,round:int,matches:array<struct<p1:string,p2:string,score1:int,score2:int,winner:string>>>>>>>>>"
GROUP = ["tournament_id", "stage_no", "group_no"]
KEY = [*GROUP, "round_no", "match_no"]


def flatten(brackets: DataFrame, data: str = "data") -> DataFrame:
    """Normalised bracket JSON as a row a match."""
    x = brackets.withColumn("b", F.from_json(data, NORMAL))
    x = x.select("tournament_id", F.posexplode("b.stages").alias("stage_no", "s"))
    x = x.select("tournament_id", "stage_no", F.col("s.name").alias("stage"), F.posexplode("s.groups").alias("group_no", "g"))
    x = x.select("tournament_id", "stage_no", "stage", "group_no", F.col("g.name").alias("group"), F.posexplode("g.rounds").alias("round_no", "r"))
    x = x.select("tournament_id", "stage_no", "stage", "group_no", "group", "round_no", F.col("r.name").alias("round"), F.posexplode("r.matches").alias("match_no", "m"))
    return x.select("tournament_id", "stage_no", "stage", "group_no", "group", "round_no", "round", "match_no", "m.*")


def has_bracket(brackets: DataFrame, data: str = "data") -> DataFrame:
    return brackets.select("tournament_id", F.coalesce(F.size(F.from_json(data, NORMAL)["stages"]) > 0, F.lit(False)).alias("has_bracket"))


def drop_empty(matches: DataFrame) -> DataFrame:
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    return matches.filter(~(empty("p1") & empty("p2")))


def merge_final(matches: DataFrame) -> DataFrame:
    """Rounds of a group named as the grand final follow the last round of the winners' group."""
    low = F.lower("group")
    final, upper = low.contains("final"), low.contains("winner") | low.contains("upper")
    w = Window.partitionBy("tournament_id", "stage_no")
    rows = matches.withColumn("_upper", F.max(F.when(upper, F.col("round_no"))).over(w)).withColumn("_no", F.max(F.when(upper, F.col("group_no"))).over(w)).withColumn("_name", F.max(F.when(upper, F.col("group"))).over(w))
    moved = final & F.col("_upper").isNotNull()
    out = rows.withColumn("round_no", F.when(moved, F.col("round_no") + F.col("_upper") + 1).otherwise(F.col("round_no")))
    out = out.withColumn("group_no", F.when(moved, F.col("_no")).otherwise(F.col("group_no"))).withColumn("group", F.when(moved, F.col("_name")).otherwise(F.col("group")))
    return out.drop("_upper", "_no", "_name")


def rename_rounds(matches: DataFrame) -> DataFrame:
    """Rounds by their distance from the last of the group: Final, Semi-final, Quarter-final, Round of 16, ..."""
    away = F.max("round_no").over(Window.partitionBy(*GROUP)) - F.col("round_no")
    name = F.when(away == 0, "Final").when(away == 1, "Semi-final").when(away == 2, "Quarter-final").when(away <= 6, F.concat(F.lit("Round of "), F.pow(F.lit(2.0), away + 1).cast("int").cast("string")))
    low = F.lower("group")
    prefix = F.when(low.contains("loser") | low.contains("lower"), "LB ").when(low.contains("winner") | low.contains("upper"), "WB ").otherwise("")
    return matches.withColumn("round", F.concat(prefix, F.coalesce(name, F.col("round"))))


def infer_winners(matches: DataFrame) -> DataFrame:
    """Where no winner is given, the player who appears in the group's next round won."""
    names = matches.select(*GROUP, (F.col("round_no") - 1).alias("round_no"), F.explode(F.array("p1", "p2")).alias("p")).filter("p is not null and p <> ''")
    ahead = names.groupBy(*GROUP, "round_no").agg(F.collect_set("p").alias("_ahead"))
    out = matches.join(ahead, [*GROUP, "round_no"], "left")
    one, two = F.coalesce(F.array_contains("_ahead", F.col("p1")), F.lit(False)), F.coalesce(F.array_contains("_ahead", F.col("p2")), F.lit(False))
    return out.withColumn("winner", F.coalesce("winner", F.when(one & ~two, "p1").when(two & ~one, "p2"))).drop("_ahead")


def advancement(matches: DataFrame) -> DataFrame:
    """Edges from a match to the first match of the next round in which its winner plays."""
    won = F.when(F.col("winner") == "p1", F.col("p1")).when(F.col("winner") == "p2", F.col("p2"))
    feeders = matches.select(*GROUP, F.col("round_no").alias("from_round"), F.col("match_no").alias("from_match"), won.alias("name"), (F.col("round_no") + 1).alias("round_no")).filter("name is not null and name <> ''")
    players = matches.select(*GROUP, "round_no", "match_no", F.explode(F.array("p1", "p2")).alias("name"))
    return feeders.join(players, [*GROUP, "round_no", "name"]).groupBy(*GROUP, "from_round", "from_match", F.col("round_no").alias("to_round")).agg(F.min("match_no").alias("to_match"))


def completeness(matches: DataFrame) -> DataFrame:
    return matches.groupBy("tournament_id").agg(F.bool_and(F.col("winner").isNotNull()).alias("complete"))
