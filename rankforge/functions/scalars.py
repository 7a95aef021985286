"""Column functions of the match domain: built-in expressions, and the volatility by arrays."""

from __future__ import annotations

import math
from html.entities import name2codepoint

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rating systems.
K_NEW, K_MID, K_OLD, NEW_GAMES, MID_GAMES = 40.0, 24.0, 16.0, 30, 100
TIERS = {"premier": 2.0, "major": 1.5, "minor": 1.0}
START, START_RD, START_VOL, MAX_RD = 1500.0, 350.0, 0.06, 350.0
SCALE, TAU = 173.7178, 1.2
#: Brackets of a root this close end its search: finer than the 1e-6 of the published method, so that engines agree.
EPSILON = 1e-12
# The alias spellings of games.
GAME_ALIASES = {
    "ql": "Quake Live",
    "quakelive": "Quake Live",
    "qc": "Quake Champions",
    "quakechampions": "Quake Champions",
    "cpm": "Quake 3 CPMA",
    "cpma": "Quake 3 CPMA",
    "q3": "Quake 3 Arena",
    "q3a": "Quake 3 Arena",
    "quake3": "Quake 3 Arena",
    "q2": "Quake 2",
    "quake2": "Quake 2",
    "q4": "Quake 4",
    "quake4": "Quake 4",
    "qw": "Quake World",
    "qworld": "Quake World",
    "quakeworld": "Quake World",
    "diabotical": "Diabotical",
    "dbt": "Diabotical",
    "br": "Blood Run",
    "bloodrun": "Blood Run",
    "ow": "Overwatch",
    "overwatch": "Overwatch",
    "ref": "Reflex",
    "reflex": "Reflex",
    "unreal": "Unreal Tournament",
    "ut": "Unreal Tournament",
    "unrealtournament": "Unreal Tournament",
    "xon": "Xonotic",
    "xonotic": "Xonotic",
}
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def match_result(p1, p2, s1, s2, winner) -> Column:
    """The first player's score: the winner id decides before the map score; else a draw."""
    p1, p2, s1, s2, winner = map(c, (p1, p2, s1, s2, winner))
    return F.when(winner == p1, 1.0).when(winner == p2, 0.0).when(s1 > s2, 1.0).when(s2 > s1, 0.0).otherwise(0.5)


def score_result(s1, s2) -> Column:
    return F.when(c(s1) > c(s2), 1.0).when(c(s1) < c(s2), 0.0).otherwise(0.5)


def base_k(games) -> Column:
    return F.when(c(games) < NEW_GAMES, K_NEW).when(c(games) <= MID_GAMES, K_MID).otherwise(K_OLD)


def k_of(games):
    """As base_k, over an array."""
    return np.where(games < NEW_GAMES, K_NEW, np.where(games <= MID_GAMES, K_MID, K_OLD))


def tier_multiplier(tier) -> Column:
    low = F.lower(F.trim(c(tier)))
    out = F.when(low == "premier", TIERS["premier"]).when(low == "major", TIERS["major"])
    return out.otherwise(TIERS["minor"])


def k_factor(tier, games) -> Column:
    return base_k(games) * tier_multiplier(tier)


def elo_expected(ra, rb) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (c(rb) - c(ra)) / 400.0))


def elo_update(ra, rb, score, ka, kb) -> tuple[Column, Column]:
    """New ratings of both sides; each side has its own K."""
    change = c(score) - elo_expected(ra, rb)
    return c(ra) + c(ka) * change, c(rb) - c(kb) * change


def glicko_g(rd, mode: str = "default") -> Column:
    """The weight of an opponent's uncertainty; mode 'paper' divides by pi squared as published."""
    return F.lit(1.0) / F.sqrt(1.0 + 3.0 * F.pow(c(rd) / SCALE, F.lit(2.0)) / (math.pi**2 if mode == "paper" else 1.0))


def glicko_expected(r, r_opp, rd_opp, mode: str = "default") -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-glicko_g(rd_opp, mode) * (c(r) - c(r_opp)) / SCALE))


def volatility(phi, vol, v, delta, tau: float = TAU, rounds: int = 40):
    """The root by the Illinois method in at most so many rounds, over arrays."""
    p2, d2, a = phi**2, delta**2, np.log(vol**2)

    def f(x):
        e = np.exp(x)
        return e * (d2 - p2 - v - e) / (2.0 * (p2 + v + e) ** 2) - (x - a) / (tau * tau)

    k = np.zeros(len(phi))
    for i in range(1, rounds + 1):
        k = np.where((k == i - 1) & (f(a - i * tau) < 0), float(i), k)
    x, y = a, np.where(d2 > p2 + v, np.log(np.maximum(d2 - p2 - v, 1e-300)), a - (k + 1) * tau)
    fx, fy = f(x), f(y)
    for _ in range(rounds):
        done = np.abs(y - x) <= EPSILON
        if done.all():
            break
        z = np.where(done, y, x + (x - y) * fx / np.where(fy != fx, fy - fx, 1.0))
        fz = f(z)
        turned = fz * fy <= 0
        x, fx = np.where(done, x, np.where(turned, y, x)), np.where(done, fx, np.where(turned, fy, fx / 2.0))
        y, fy = z, np.where(done, fy, fz)
    return np.exp(x / 2.0)


def glicko_volatility(phi, vol, v, delta, tau: float = TAU, rounds: int = 40) -> Column:
    """The new volatility: the root of the period's likelihood, by arrays; null where a value is."""

    @F.pandas_udf("double")
    def root(phi: pd.Series, vol: pd.Series, v: pd.Series, delta: pd.Series) -> pd.Series:
        return pd.Series(volatility(*[x.to_numpy(float) for x in (phi, vol, v, delta)], tau, rounds))

    given = [c(x).cast("double") for x in (phi, vol, v, delta)]
    return F.when(F.forall(F.array(*given), lambda x: x.isNotNull()), root(*given))


def conservative(rating, rd) -> Column:
    return c(rating) - F.coalesce(c(rd), F.lit(0.0))


def period_start(ts, unit: str) -> Column:
    """Midnight at the start of the year, month, ISO week (Monday) or day."""
    return F.date_trunc(unit, c(ts))


def period_key(ts, unit: str) -> Column:
    start = period_start(ts, unit)
    match unit:
        case "year":
            return F.date_format(start, "yyyy")
        case "month":
            return F.date_format(start, "yyyy-MM")
        case "week":
            return F.concat(F.extract(F.lit("YEAROFWEEK"), c(ts)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c(ts)).cast("string"), 2, "0"))
    return F.date_format(start, "yyyy-MM-dd")


def winner_name(p1, p2, winner, name1, name2) -> Column:
    return F.when(c(winner) == c(p1), c(name1)).when(c(winner) == c(p2), c(name2))


def is_duel(fmt) -> Column:
    low = F.lower(c(fmt))
    return (low.contains("duel") & ~low.contains("team")) | low.contains("1v1")


def win_rate(wins, matches) -> Column:
    return F.try_divide(c(wins).cast("double"), c(matches))


def ordinal_rank(text) -> Column:
    """Leading digits of '1st', '2nd', ...; 0 if there are none."""
    return F.coalesce(F.expr(f"try_cast(regexp_extract({text}, '^(\\\\d+)', 1) as int)") if isinstance(text, str) else F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.lit(0))


def parse_ordinal_date(day, time) -> Column:
    """'1st August 2026' and '20:30 UTC'."""
    plain = F.regexp_replace(c(day), r"(?i)(\d+)(st|nd|rd|th)\b", "$1")
    clock = F.regexp_extract(c(time), r"(\d{1,2}:\d{2})", 1)
    return F.try_to_timestamp(F.concat_ws(" ", plain, clock), F.lit("d MMMM yyyy H:mm"))


def parse_list_date(text) -> Column:
    """'02 Aug 2026 17:45 UTC'; 2000-01-01 where it cannot be read."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c(text), r"\s*UTC\s*$", ""), F.lit("dd MMM yyyy HH:mm")), F.lit("2000-01-01 00:00:00").cast("timestamp"))


def parse_schedule(text) -> tuple[Column, Column]:
    """Start and end of '09 Aug 2026 - 16:00 UTC -> 20:15 UTC' (one day, two times)."""
    day = F.regexp_extract(c(text), r"(\d{1,2} \w{3} \d{4})", 1)
    times = F.regexp_extract_all(c(text), F.lit(r"(\d{1,2}:\d{2}) UTC"), F.lit(1))
    at = lambda i: F.try_to_timestamp(F.concat_ws(" ", day, F.get(times, F.lit(i))), F.lit("d MMM yyyy H:mm"))
    return F.when(F.size(times) > 0, at(0)), F.when(F.size(times) > 1, at(1))


def parse_iso(text) -> Column:
    """ISO date and time with T or a space, or a date alone; null where it cannot be read."""
    clean = F.regexp_replace(F.regexp_replace(c(text), "T", " "), r"(\.\d+)?(Z|[+-]\d\d:?\d\d)?$", "")
    return F.coalesce(F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(clean, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(clean, F.lit("yyyy-MM-dd")))


def vod_url(platform, video) -> Column:
    p, v = F.lower(c(platform)), c(video)
    url = F.when(p == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), v)).when(p == "twitch", F.concat(F.lit("https://www.twitch.tv/videos/"), v)).when(p == "vimeo", F.concat(F.lit("https://vimeo.com/"), v))
    return F.coalesce(url, F.lit(""))


def slug(text, default: str = "player") -> Column:
    plain = F.lower(F.regexp_replace(c(text), r"[^\w\s-]", ""))
    out = F.regexp_replace(F.regexp_replace(plain, r"[\s_]+", "-"), r"^-+|-+$", "")
    return F.when(out == "", default).otherwise(F.coalesce(out, F.lit(default)))


def resolve_game(name) -> Column:
    """The canonical name of an alias; other names pass."""
    known = F.create_map(*[x for k, v in GAME_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[F.lower(F.trim(c(name)))], c(name))


def strip_tags(html) -> Column:
    return F.regexp_replace(c(html), r"<[^>]+>", "")


def character(code: Column) -> Column:
    """The character of a code point; null if there is none. 128 to 159 mean Windows-1252, as in browsers."""
    windows = {i: ord(x) for i in range(128, 160) if (x := bytes([i]).decode("cp1252", "ignore"))}
    code = F.coalesce(F.create_map(*[F.lit(x) for pair in windows.items() for x in pair])[code], code)
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), text)


def unescape(text) -> Column:
    """text with named (HTML 4 and apos), decimal and hexadecimal entities replaced once; unknown ones stay, nbsp is a plain space."""
    out = c(text)
    points = name2codepoint | {"apos": 39, "nbsp": 32}
    names = F.create_map(*[F.lit(x) for pair in points.items() for x in pair])

    def plain(e: Column) -> Column:
        inner = F.substring(e, F.lit(2), F.char_length(e) - 2)
        hexed = F.conv(F.substring(inner, F.lit(3), F.char_length(inner)), 16, 10).cast("int")
        number = F.when(F.rlike(inner, F.lit("^#[xX]")), hexed).when(F.startswith(inner, F.lit("#")), F.substring(inner, F.lit(2), F.char_length(inner)).cast("int")).otherwise(names[inner])
        return F.coalesce(F.when(number == 160, " ").otherwise(character(number)), e)

    found = F.transform(F.regexp_extract_all(out, F.lit(ENTITY), F.lit(0)), plain)
    parts = F.zip_with(F.split(out, ENTITY, -1), found, lambda p, e: F.concat(p, F.coalesce(e, F.lit(""))))
    return F.when(F.rlike(out, F.lit(ENTITY)), F.array_join(parts, "")).otherwise(out)


def score_text(s1, s2) -> Column:
    return F.concat_ws("-", c(s1).cast("string"), c(s2).cast("string"))


def oriented_score(player, p2, s1, s2) -> Column:
    return F.when(c(player) == c(p2), score_text(s2, s1)).otherwise(score_text(s1, s2))


def map_display(name) -> Column:
    return F.when(c(name).isNull() | (c(name) == "?"), "Unknown").otherwise(c(name))
