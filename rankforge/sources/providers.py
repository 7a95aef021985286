"""Bracket payloads of providers as a long table of matches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = ["tournament_id", "stage_no", "stage", "group_no", "group", "round_no", "round", "match_no", "p1", "p2", "score1", "score2", "winner"]

# Payload schemas, and the names and order of bracket sides.
TOORNAMENT = "struct<stages:array<struct<id:string,name:string,closed:boolean>>,matches:array<struct<stage:struct<id:string>,group:struct<id:string,name:string>,round:struct<number:int,name:string>,number:int,opponents:array<struct<participant:struct<name:string>,score:int,result:string>>>>>"
SHAMBLER = "struct<title:string,status:int,players:array<struct<id:string,discord_name:string>>,brackets:array<struct<id:string,matches:array<struct<round:int,num:int,players:array<string>,scores:array<int>>>>>>"
EGB = "struct<name:string,participants:array<struct<id:string,displayName:string>>,matches:array<struct<side:string,round:int,indexInRound:int,status:string,winner:string,home:struct<type:string,participant:string>,away:struct<type:string,participant:string>,score:struct<home:int,away:int>>>>"
KUACHI = "struct<title:string,stage_id:string,matches:array<struct<id:string,cup_stage_id:string,low_id:string,high_id:string,elim_type:string,elim_round:int,elim_index:int,group_no:int,group_round:int,is_scored:boolean,winner_id:string,low_report:array<struct<low:int,high:int>>,high_report:array<struct<low:int,high:int>>>>,signups:array<struct<id:string,player_id:string>>,profiles:array<struct<id:string,discord_username:string>>>"
SIDES = {"wb": "Winners Bracket", "lb": "Losers Bracket", "gf": "Grand Final", "WINNERS": "Winners Bracket", "LOSERS": "Losers Bracket", "GRAND_FINAL": "Grand Final", "GRAND_FINAL_RESET": "Grand Final Reset", "WB": "Winners Bracket", "LB": "Losers Bracket", "GF": "Grand Final", "GF1": "Grand Final", "GF2": "Grand Final Reset"}
FINISHED = ("COMPLETED", "WALKOVER", "CANCELLED")


def side_name(side: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SIDES.items() for x in pair])
    return F.coalesce(known[side], side)


def group_rank(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("winner"), 0).when(low.contains("loser"), 1).when(low.contains("grand") | low.contains("final"), 2).otherwise(3)


def numbered(rows: DataFrame, stage_keys: list[str], order: list[str]) -> DataFrame:
    """Group numbers by side (winners, losers, finals) and match numbers in their round."""
    groups = rows.select(*stage_keys, "group").distinct()
    groups = groups.withColumn("group_no", F.row_number().over(Window.partitionBy(*stage_keys).orderBy(group_rank(F.col("group")), "group")) - 1)
    w = Window.partitionBy(*stage_keys, "group", "round_no").orderBy(*order)
    return rows.join(groups, [*stage_keys, "group"]).withColumn("match_no", F.row_number().over(w) - 1).select(*LONG)


def looked_up(array: Column, key: Column, value: str) -> Column:
    return F.coalesce(F.element_at(F.map_from_entries(F.transform(array, lambda p: F.struct(p["id"], p[value]))), key), F.lit(""))


def toornament(payloads: DataFrame) -> DataFrame:
    x = payloads.withColumn("j", F.from_json("payload", TOORNAMENT))
    stages = x.select("tournament_id", F.posexplode("j.stages").alias("stage_no", "s")).select("tournament_id", "stage_no", F.col("s.id").alias("sid"), F.col("s.name").alias("stage"))
    m = x.select("tournament_id", F.posexplode("j.matches").alias("i", "m")).join(stages.withColumnRenamed("tournament_id", "_t"), (F.col("tournament_id") == F.col("_t")) & (F.col("m.stage.id") == F.col("sid")))
    o = lambda i, f: F.get("m.opponents", F.lit(i)).getField(f)
    name = lambda i: F.coalesce(o(i, "participant").getField("name"), F.lit(""))
    rows = m.select("tournament_id", "stage_no", "stage", F.coalesce("m.group.name", F.lit("")).alias("group"), F.coalesce("m.round.number", F.lit(0)).alias("round_no"), F.coalesce("m.round.name", F.lit("")).alias("round"), "i", name(0).alias("p1"), name(1).alias("p2"), o(0, "score").alias("score1"), o(1, "score").alias("score2"), F.when(o(0, "result") == "win", "p1").when(o(1, "result") == "win", "p2").alias("winner"))
    return numbered(rows, ["tournament_id", "stage_no", "stage"], ["i"])


def shambler(payloads: DataFrame) -> DataFrame:
    x = payloads.withColumn("j", F.from_json("payload", SHAMBLER))
    b = x.select("tournament_id", F.col("j.title").alias("stage"), F.col("j.players").alias("ps"), F.explode("j.brackets").alias("b"))
    m = b.select("tournament_id", "stage", "ps", side_name(F.col("b.id")).alias("group"), F.explode("b.matches").alias("m"))
    player = lambda i: looked_up(F.col("ps"), F.get("m.players", F.lit(i)), "discord_name")
    s1, s2 = F.get("m.scores", F.lit(0)), F.get("m.scores", F.lit(1))
    rows = m.select("tournament_id", F.lit(0).alias("stage_no"), "stage", "group", F.coalesce("m.round", F.lit(0)).alias("round_no"), F.concat(F.lit("Round "), (F.coalesce("m.round", F.lit(0)) + 1).cast("string")).alias("round"), F.coalesce("m.num", F.lit(0)).alias("i"), player(0).alias("p1"), player(1).alias("p2"), s1.alias("score1"), s2.alias("score2"), F.when(s1 > s2, "p1").when(s2 > s1, "p2").alias("winner"))
    return numbered(rows, ["tournament_id", "stage_no", "stage"], ["i"])


def egb(payloads: DataFrame) -> DataFrame:
    x = payloads.withColumn("j", F.from_json("payload", EGB))
    m = x.select("tournament_id", F.col("j.name").alias("stage"), F.col("j.participants").alias("ps"), F.explode("j.matches").alias("m"))
    player = lambda s: F.when(F.col(f"m.{s}.type") == "player", looked_up(F.col("ps"), F.col(f"m.{s}.participant"), "displayName")).otherwise("")
    rows = m.select("tournament_id", F.lit(0).alias("stage_no"), "stage", side_name(F.coalesce("m.side", F.lit(""))).alias("group"), F.coalesce("m.round", F.lit(1)).alias("round_no"), F.concat(F.lit("Round "), F.coalesce("m.round", F.lit(1)).cast("string")).alias("round"), F.coalesce("m.indexInRound", F.lit(0)).alias("i"), player("home").alias("p1"), player("away").alias("p2"), F.col("m.score.home").alias("score1"), F.col("m.score.away").alias("score2"), F.when(F.col("m.winner") == F.col("m.home.participant"), "p1").when(F.col("m.winner") == F.col("m.away.participant"), "p2").alias("winner"))
    return numbered(rows, ["tournament_id", "stage_no", "stage"], ["i"])


def kuachi(payloads: DataFrame) -> DataFrame:
    """Scores are maps won in the reports; matches with one side only are left out."""
    x = payloads.withColumn("j", F.from_json("payload", KUACHI))
    m = x.select("tournament_id", F.col("j.title").alias("stage"), F.col("j.stage_id").alias("sid"), F.col("j.signups").alias("su"), F.col("j.profiles").alias("pr"), F.explode("j.matches").alias("m"))
    m = m.filter("m.cup_stage_id = sid and m.low_id is not null and m.high_id is not null and m.low_id <> '' and m.high_id <> ''")
    player = lambda k: looked_up(F.col("pr"), looked_up(F.col("su"), F.col(k), "player_id"), "discord_username")
    report = F.coalesce("m.low_report", "m.high_report")
    won = lambda a, b: F.when(report.isNotNull(), F.size(F.filter(report, lambda r: F.coalesce(r[a], F.lit(0)) > F.coalesce(r[b], F.lit(0)))))
    elim = F.coalesce("m.elim_type", F.lit("")) != ""
    round_no = F.coalesce(F.when(elim, F.col("m.elim_round")).otherwise(F.col("m.group_round")), F.lit(0))
    group = F.when(elim, side_name(F.col("m.elim_type"))).otherwise(F.concat(F.lit("Group "), (F.coalesce("m.group_no", F.lit(0)) + 1).cast("string")))
    rows = m.select("tournament_id", F.lit(0).alias("stage_no"), "stage", group.alias("group"), round_no.alias("round_no"), F.concat(F.lit("Round "), (round_no + 1).cast("string")).alias("round"), F.coalesce("m.elim_index", F.lit(0)).alias("i"), F.col("m.id").alias("id"), player("m.low_id").alias("p1"), player("m.high_id").alias("p2"), won("low", "high").alias("score1"), won("high", "low").alias("score2"), F.when(F.col("m.winner_id") == F.col("m.low_id"), "p1").when(F.col("m.winner_id") == F.col("m.high_id"), "p2").alias("winner"))
    return numbered(rows, ["tournament_id", "stage_no", "stage"], ["i", "id"])


NORMALIZERS = {"toornament": toornament, "shambler": shambler, "egb": egb, "kuachi": kuachi}


def normalize(payloads: DataFrame) -> DataFrame:
    """All providers' payloads (tournament_id, kind, payload) as one long table."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [f(payloads.filter(F.col("kind") == kind)) for kind, f in NORMALIZERS.items()])


def provider_complete(payloads: DataFrame) -> DataFrame:
    """Whether each provider says that its bracket is over."""
    k, p = F.col("kind"), F.col("payload")
    over = (
        F.when(k == "toornament", F.forall(F.coalesce(F.from_json(p, TOORNAMENT)["stages"], F.array().cast("array<struct<id:string,name:string,closed:boolean>>")), lambda s: F.coalesce(s["closed"], F.lit(False))))
        .when(k == "shambler", F.from_json(p, SHAMBLER)["status"] == 2)
        .when(k == "egb", F.forall(F.from_json(p, EGB)["matches"], lambda m: m["status"].isin(*FINISHED)))
        .when(k == "kuachi", F.forall(F.from_json(p, KUACHI)["matches"], lambda m: F.coalesce(m["is_scored"], F.lit(False)) | (m["cup_stage_id"] != F.from_json(p, KUACHI)["stage_id"])))
    )
    return payloads.select("tournament_id", F.coalesce(over, F.lit(False)).alias("complete"))


#: Tags with quoted attributes and texts without signs that a parser would read into; tags whose texts are raw.
PLAIN = re.compile(r'(<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>|([^<>&\0]+))')
VALUES = re.compile(r' ([a-z-]+)="([^"]*)"')
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _Rounds(HTMLParser):
    """Collects titles and cells of a bracket's columns."""

    def __init__(self):
        super().__init__()
        self.stack: list[str] = []
        self.columns: list[dict] = []

    def read(self, html: str) -> list[dict]:
        """The columns of a page; one of plain tags and texts alone is cut by a pattern, with the same outcome."""
        tokens = PLAIN.findall(html)
        if sum(map(len, (t[0] for t in tokens))) < len(html) or not RAW.isdisjoint(t[2] for t in tokens):
            self.feed(html)
            return self.columns
        for whole, end, tag, attrs, text in tokens:
            if text:
                self.handle_data(text)
            elif end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, VALUES.findall(attrs))
        return self.columns

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = (a.get("class") or "").split()
        kind = next((n for n in ("bracket-column", "bracket-round-title", "bracket-match", "bracket-name", "bracket-score") if n in names), "cell" if any("bracket-cell-r" in n for n in names) else "")
        if tag in ("br", "img", "hr", "input"):
            return
        self.stack.append(kind)
        if kind == "bracket-column":
            self.columns.append({"title": "", "matches": []})
        elif kind == "bracket-match" and self.columns:
            self.columns[-1]["matches"].append([])
        elif kind == "cell" and self.columns and self.columns[-1]["matches"]:
            self.columns[-1]["matches"][-1].append({"name": "", "score": "", "won": False})
        elif kind == "bracket-name" and "font-weight:700" in (a.get("style") or "").replace(" ", "") and self.cell():
            self.cell()["won"] = True

    def cell(self):
        m = self.columns[-1]["matches"] if self.columns else []
        return m[-1][-1] if m and m[-1] else None

    def handle_endtag(self, tag):
        if self.stack and tag not in ("br", "img", "hr", "input"):
            self.stack.pop()

    def handle_data(self, data):
        inside = next((k for k in reversed(self.stack) if k), "")
        if inside == "bracket-round-title" and self.columns:
            self.columns[-1]["title"] += data.strip()
        elif inside in ("bracket-name", "bracket-score") and self.cell():
            self.cell()["name" if inside == "bracket-name" else "score"] += data.strip()


def native(pages: DataFrame) -> DataFrame:
    """Brackets drawn in the page itself (tournament_id, html); the name in bold won."""

    def task(frames):
        for f in frames:
            out = []
            for t, html in zip(f["tournament_id"], f["html"]):
                rounds = [c for c in _Rounds().read(html or "") if any(len(m) >= 2 for m in c["matches"])]
                kinds = {"Winners Bracket": [], "Losers Bracket": [], "Grand Final": []}
                for c in rounds:
                    low = c["title"].lower()
                    kinds["Grand Final" if "grand final" in low else "Losers Bracket" if low.startswith(("lb", "loser")) else "Winners Bracket"].append(c)
                for g, (name, cs) in enumerate((k, v) for k, v in kinds.items() if v):
                    for r, c in enumerate(cs):
                        for i, m in enumerate(x for x in c["matches"] if len(x) >= 2):
                            s = [int(x["score"]) if x["score"].isdigit() else None for x in m[:2]]
                            out.append((t, 0, "", g, name, r, c["title"], i, m[0]["name"], m[1]["name"], s[0], s[1], "p1" if m[0]["won"] else "p2" if m[1]["won"] else None))
            yield pd.DataFrame(out, columns=LONG).astype({"score1": "Int32", "score2": "Int32"})

    return pages.select("tournament_id", "html").mapInPandas(task, "tournament_id long, stage_no int, stage string, group_no int, group string, round_no int, round string, match_no int, p1 string, p2 string, score1 int, score2 int, winner string")
