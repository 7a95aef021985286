"""Ratings against a scalar fold written from the formulas, and their invariants."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions import scalars as S
from rankforge.operators import ratings as G
from rankforge.sources.store import stored

COLUMNS = "match_id long, player1_id long, player2_id long, player1_score int, player2_score int, winner_id long, game_id int, match_format string, tournament_id long, played_at timestamp"


def league(n=120, players=9, seed=1, first=0):
    rng, rows = random.Random(seed), []
    for i in range(first, first + n):
        a, b = rng.sample(range(1, players + 1), 2)
        s1, s2 = rng.randint(0, 3), rng.randint(0, 3)
        winner = a if s1 > s2 else b if s2 > s1 else rng.choice([None, a])
        rows.append((i, a, b, s1, s2, winner, rng.choice([1, 2]), rng.choice(["1v1", "Duel", "Team Duel"]), rng.choice([None, 1, 2]), dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 3)))
    return rows


def duels(rows, pool):
    return [r for r in sorted(rows, key=lambda r: (r[9], r[0])) if r[7] != "Team Duel" and pool in (0, r[6])]


def k(games):
    return 40 if games < 30 else 24 if games <= 100 else 16


def scalar_elo(rows, pool, tiers=None):
    rating, count, out = {}, {}, {}
    for m, a, b, s1, s2, w, _, _, t, _ in duels(rows, pool):
        s = 1.0 if w == a else 0.0 if w == b else 1.0 if s1 > s2 else 0.0 if s2 > s1 else 0.5
        mult = {"premier": 2.0, "major": 1.5}.get((tiers or {}).get(t), 1.0)
        ra, rb = rating.get(a, 1500.0), rating.get(b, 1500.0)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        rating[a], rating[b] = ra + k(count.get(a, 0)) * mult * (s - e), rb - k(count.get(b, 0)) * mult * (s - e)
        for p in (a, b):
            count[p] = count.get(p, 0) + 1
            out[p, m] = (rating[p], count[p])
    return out


def got(df):
    return {(r["player_id"], r["match_id"]): (r["rating"], r["matches_played"]) for r in df.collect()}


@pytest.mark.parametrize("seed,fold", [(1, G.FOLD), (2, G.FOLD), (1, 0), (2, 90)])
def test_elo_equals_scalar_fold(spark, seed, fold):
    """Folded by pool, swept, and both for pools of different sizes."""
    rows = league(seed=seed)
    tiers = spark.createDataFrame([(1, "premier"), (2, "major")], "tournament_id long, tier string")
    history = G.elo(spark.createDataFrame(rows, COLUMNS).repartition(7), tiers, fold).cache()
    for pool in (0, 1, 2):
        mine, want = got(history.filter(F.col("game_id") == pool)), scalar_elo(rows, pool, {1: "premier", 2: "major"})
        assert mine.keys() == want.keys()
        assert all(mine[x][0] == pytest.approx(want[x][0], abs=1e-8) and mine[x][1] == want[x][1] for x in want)


def test_sweeps_hold_a_part_of_the_players_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(G, "SWEPT", 5)
    rows = league(60)
    assert {x: v[0] for x, v in got(G.elo(spark.createDataFrame(rows, COLUMNS), fold=0).filter("game_id = 0")).items()} == pytest.approx({x: v[0] for x, v in scalar_elo(rows, 0).items()}, abs=1e-8)


def test_no_task_gets_more_than_a_turn_of_a_pool(spark, monkeypatch):
    """Pools go on from the states of the turn before, with self-matches and states given; each turn is a few duels."""
    monkeypatch.setattr(G, "SWEPT", 20)
    rows = [(r[0], r[1], r[1], *r[3:]) if r[0] == 7 else r for r in league(100)]
    turns, step = [], G.folded
    monkeypatch.setattr(G, "folded", lambda part, *more: turns.append(part.groupBy("pool").count().agg(F.max("count")).first()[0]) or step(part, *more))
    matches = spark.createDataFrame(rows, COLUMNS)
    before = stored(G.elo(matches.filter("match_id < 40")))
    assert len(turns) == 1
    flat = lambda df: sorted(((r["game_id"], r["match_id"], r["player_id"], r["matches_played"]), (round(r["rating"], 9), r["wins"], r["losses"])) for r in df.collect())
    whole = flat(G.elo(matches))
    assert flat(G.elo_incremental(before, matches, fold=0)) == whole and flat(G.elo(matches, fold=0)) == whole
    assert len(turns) >= 10 and max(turns[4:]) <= 23


def test_elo_of_nothing(spark):
    assert G.elo(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("late,fold", [(False, G.FOLD), (True, G.FOLD), (False, 0)])
def test_incremental_equals_full(spark, late, fold):
    rows = league()
    old = rows[:80]
    new = rows[80:] if not late else rows[80:] + [(999, 1, 2, 3, 0, 1, 1, "1v1", None, dt.datetime(2024, 1, 3))]
    before = stored(G.elo(spark.createDataFrame(old, COLUMNS)))
    after = stored(G.elo_incremental(before, spark.createDataFrame(old + new, COLUMNS), fold=fold))
    for pool in (0, 1, 2):
        mine, want = got(after.filter(F.col("game_id") == pool)), scalar_elo(old + new, pool)
        assert mine.keys() == want.keys()
        assert all(mine[x][0] == pytest.approx(want[x][0], abs=1e-8) and mine[x][1] == want[x][1] for x in want)


def test_pools_are_folded_from_their_first_new_match_on(spark, monkeypatch):
    """Late matches do not fold whole pools again; a pool without new matches is not folded, a new one is whole."""
    rows = [(r[0], r[1], r[1], *r[3:]) if r[0] == 50 else r for r in league(150)]
    other = (500, 1, 2, 3, 0, 1, 3, "1v1", None, dt.datetime(2024, 1, 5))
    late = [(900, 1, 2, 3, 0, 1, 1, "1v1", None, dt.datetime(2024, 2, 10)), (901, 3, 4, 1, 2, 4, 1, "1v1", None, dt.datetime(2024, 2, 1)), (902, 5, 6, 1, 2, 6, 4, "1v1", None, dt.datetime(2024, 2, 9))]
    before = stored(G.elo(spark.createDataFrame([*rows, other], COLUMNS)))
    seen, step = {}, G.folded
    monkeypatch.setattr(G, "folded", lambda part, *more: seen.update((r["pool"], r["count"]) for r in part.groupBy("pool").count().collect()) or step(part, *more))
    after = G.elo_incremental(before, spark.createDataFrame([*rows, other, *late], COLUMNS))
    all_rows = [*rows, other, *late]
    assert seen == {p: sum((r[9], r[0]) >= begin for r in duels(all_rows, p)) for p, begin in ((0, (dt.datetime(2024, 2, 1), 901)), (1, (dt.datetime(2024, 2, 1), 901)), (4, (dt.datetime(2024, 2, 9), 902)))}
    flat = lambda df: sorted((r["game_id"], r["match_id"], r["player_id"], r["matches_played"], round(r["rating"], 9), r["wins"], r["losses"]) for r in df.collect())
    assert flat(after) == flat(G.elo(spark.createDataFrame(all_rows, COLUMNS)))


def volatility_residual(phi, vol, v, delta, new):
    a, x = math.log(vol**2), math.log(new**2)
    e = math.exp(x)
    return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - a) / S.TAU**2


def test_volatility_is_the_root(spark):
    cases = [(2.0, 0.06, 0.7, 0.1), (0.3, 0.06, 0.5, 3.0), (1.0, 0.2, 2.0, -2.5), (2.0, 0.06, 1.5, 0.0), (0.5, 1.2, 0.3, 8.0)]
    df = spark.createDataFrame(cases, "phi double, vol double, v double, delta double")
    for r in df.withColumn("new", S.glicko_volatility("phi", "vol", "v", "delta")).collect():
        assert abs(volatility_residual(r["phi"], r["vol"], r["v"], r["delta"], r["new"])) < 1e-6


def scalar_volatility(phi, vol, v, delta):
    a = math.log(vol**2)
    f = lambda x: math.exp(x) * (delta**2 - phi**2 - v - math.exp(x)) / (2 * (phi**2 + v + math.exp(x)) ** 2) - (x - a) / S.TAU**2
    lo, hi = a - 50, a + 50
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return math.exp(lo / 2)


def scalar_glicko(rows, pool):
    own, state, out = duels(rows, pool), {}, []
    months = sorted({(r[9].year, r[9].month) for r in own})
    for n, month in enumerate(months, 1):
        for p, (r, rd, vol) in list(state.items()):
            state[p] = (r, rd, vol)
        games = {}
        for r in (r for r in own if (r[9].year, r[9].month) == month):
            s = 1.0 if r[3] > r[4] else 0.0 if r[4] > r[3] else 0.5
            games.setdefault(r[1], []).append((r[2], s))
            games.setdefault(r[2], []).append((r[1], 1 - s))
        new = {}
        for p, opponents in games.items():
            r, rd, vol = state.get(p, (1500.0, 350.0, 0.06))
            info = gain = 0.0
            for o, s in opponents:
                ro, rdo, _ = state.get(o, (1500.0, 350.0, 0.06))
                g = 1 / math.sqrt(1 + 3 * (rdo / S.SCALE) ** 2)
                e = 1 / (1 + math.exp(-g * (r - ro) / S.SCALE))
                info, gain = info + g * g * e * (1 - e), gain + g * (s - e)
            phi, v = rd / S.SCALE, 1 / info
            vol = scalar_volatility(phi, vol, v, v * gain)
            phi = math.sqrt(1 / (1 / phi**2 + 1 / v) + vol**2)
            new[p] = (r + S.SCALE * phi**2 * gain, min(350.0, phi * S.SCALE), vol)
        for p, (r, rd, vol) in list(state.items()):
            if p not in new:
                state[p] = (r, min(350.0, math.sqrt(rd**2 + (S.SCALE * vol) ** 2)), vol)
        state.update(new)
        out += [(p, n, *new[p]) for p in new]
    return {(p, n): x for p, n, *x in out}


@pytest.mark.parametrize("fold", [G.FOLD, 0])
def test_glicko_equals_scalar_and_incremental_equals_full(spark, fold, monkeypatch):
    monkeypatch.setattr(G, "COMPACT", 1)
    rows = league(150)
    matches = spark.createDataFrame(rows, COLUMNS)
    full = stored(G.glicko2(matches, "month", keep=stored, fold=fold))
    mine = {(r["player_id"], r["n"]): (r["rating"], r["rd"], r["vol"]) for r in full.filter("game_id = 0").collect()}
    want = scalar_glicko(rows, 0)
    assert mine.keys() == want.keys()
    for x in want:
        assert mine[x] == pytest.approx(tuple(want[x]), abs=1e-3)
    cut = spark.createDataFrame([r for r in rows if r[9] < dt.datetime(2024, 2, 20)], COLUMNS)
    again = G.glicko2_incremental(stored(G.glicko2(cut, "month", keep=stored, fold=fold)), matches, "month", keep=stored, fold=fold)
    other = {(r["player_id"], r["n"]): r["rating"] for r in again.filter("game_id = 0").collect()}
    assert other == pytest.approx({x: v[0] for x, v in mine.items()}, abs=1e-6)


def test_glicko_takes_large_pools_in_turns(spark, monkeypatch):
    """No task gets more of a pool than a turn and the rest of its period, and states are carried."""
    matches = spark.createDataFrame(league(200, seed=4), COLUMNS)
    flat = lambda df: sorted((r["game_id"], r["n"], r["player_id"], r["match_id"], r["matches_played"], round(r["rating"], 7), round(r["rd"], 7), round(r["vol"], 9)) for r in df.collect())
    whole = flat(G.glicko2(matches, "week"))
    monkeypatch.setattr(G, "SWEPT", 25)
    turns, step = [], G.glicko_folded
    monkeypatch.setattr(G, "glicko_folded", lambda part, *more: turns.append(part.groupBy("pool").count().agg(F.max("count")).first()[0]) or step(part, *more))
    assert flat(G.glicko2(matches, "week", fold=30)) == whole
    assert len(turns) > 2 and max(turns) <= 2 * (30 + 21)


def test_volatility_over_arrays_is_that_of_columns(spark):
    rng = random.Random(3)
    cases = [(rng.uniform(0.2, 2.1), rng.uniform(0.03, 1.2), rng.uniform(0.1, 3), rng.uniform(-6, 6)) for _ in range(300)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, phi double, vol double, v double, delta double")
    want = [r["new"] for r in df.withColumn("new", S.glicko_volatility("phi", "vol", "v", "delta")).orderBy("i").collect()]
    assert G.volatility(*map(np.array, zip(*cases))).tolist() == pytest.approx(want, rel=1e-9)


def test_glicko_incremental_of_pools_with_different_periods(spark):
    row = lambda i, game, month: (i, 1 + i % 3, 4 + i % 2, 2, 1, 1 + i % 3, game, "1v1", 1, dt.datetime(2024, month, 3))
    rows = [row(i, 1, 1 + i % 5) for i in range(20)] + [row(100 + i, 2, 1 + i % 2) for i in range(6)]
    later = [row(200, 1, 7), row(201, 2, 6), row(202, 3, 6)]
    columns = "match_id long, player1_id long, player2_id long, player1_score int, player2_score int, winner_id long, game_id int, match_format string, tournament_id long, played_at timestamp"
    before, after = spark.createDataFrame(rows, columns), spark.createDataFrame(rows + later, columns)
    first = stored(G.glicko2(before, "month", keep=stored))
    key = lambda df: {(r["player_id"], r["game_id"], r["n"]): round(r["rating"], 6) for r in df.collect()}
    assert key(G.glicko2_incremental(first, after, "month", keep=stored)) == key(G.glicko2(after, "month", keep=stored))


def test_match_state_and_corrupt_ratings(spark):
    rows = league(60)
    m = spark.createDataFrame(rows, COLUMNS)
    history = stored(G.elo(m))
    assert {r["state"] for r in G.match_state(m, history).collect()} == {"up_to_date"}
    assert "new_matches" in {r["state"] for r in G.match_state(m, stored(G.elo(m.filter("match_id < 50")))).collect()}
    broken = history.withColumn("rating", F.when(F.col("game_id") == 0, F.lit(float("nan"))).otherwise(F.col("rating")))
    assert {r["pool"]: r["state"] for r in G.match_state(m, broken).collect()}[0] == "backfill"


def test_registered_glicko_is_by_month(spark, monkeypatch):
    from rankforge.plans import queries

    units = []
    monkeypatch.setattr(queries.G, "glicko2", lambda matches, unit, keep: units.append(unit) or matches.selectExpr("1L as player_id", "game_id", "1 as n", "match_id", "1.0 as rating", "1.0 as rd", "1.0 as vol", "1 as wins", "1 as losses", "1 as matches_played"))
    queries.QUERIES["g4_glicko2"](spark, "/root/testdata/sf0.001")
    assert units == ["month"]


def test_pools_without_turns_are_folded_beside_those_with(spark, monkeypatch):
    monkeypatch.setattr(G, "SWEPT", 20)
    rows = league(100)
    fold = max(len(duels(rows, 1)), len(duels(rows, 2)))
    seen, step = [], G.folded
    monkeypatch.setattr(G, "folded", lambda part, *more: seen.append({r["pool"] for r in part.select("pool").distinct().collect()}) or step(part, *more))
    history = G.elo(spark.createDataFrame(rows, COLUMNS), fold=fold)
    assert len(seen) > 3 and [pools for pools in seen if pools != {0}] == [{1, 2}]
    for pool in (0, 1, 2):
        mine, want = got(history.filter(F.col("game_id") == pool)), scalar_elo(rows, pool)
        assert {x: v[1] for x, v in mine.items()} == {x: v[1] for x, v in want.items()}
        assert {x: v[0] for x, v in mine.items()} == pytest.approx({x: v[0] for x, v in want.items()}, abs=1e-8)


def test_glicko_stores_periods_not_matches(spark):
    """Last matches and counters of a period are those of the running counters, self-matches and matches without a date included."""
    rows = [(r[0], r[1], r[1], *r[3:]) if r[0] % 40 == 7 else (*r[:6], None, *r[7:]) if r[0] % 9 == 0 else (*r[:9], None) if r[0] % 50 == 3 else r for r in league(150)]
    matches, kept = spark.createDataFrame(rows, COLUMNS), []
    got = G.glicko2(matches, "week", keep=lambda df: kept.append(df.count()) or stored(df))
    each = G.counters(G.rating_input(matches).withColumn("result", S.score_result("player1_score", "player2_score"))).withColumn("period", S.period_start("played_at", "week"))
    want = each.filter("period is not null").groupBy("pool", "player_id", "period").agg(F.max(F.struct("played_at", "match_id", "wins", "losses", "matches_played")).alias("t")).select("pool", "player_id", "t.*")
    names = ("player_id", "match_id", "played_at", "wins", "losses", "matches_played")
    assert sorted(map(tuple, got.select("game_id", *names).collect())) == sorted(map(tuple, want.select("pool", *names).collect()))
    assert max(kept) == each.select("pool", "period").distinct().count()


def test_a_period_without_information_leaves_players_as_they_are(spark):
    """Ratings so far apart that nothing can be learned are no division by zero."""
    games = spark.createDataFrame([(0, 1, 2, 1.0, 2), (0, 3, 4, 1.0, 2)], "pool int, player_id long, opponent_id long, score double, n int")
    state = spark.createDataFrame([(0, 1, 1e9, 50.0, 0.06, 1), (0, 2, -1e9, 50.0, 0.06, 1)], G.STATE)
    assert [r["player_id"] for r in G.glicko_period(games, state).collect()] == [3]
