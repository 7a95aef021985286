"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from rankforge.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(doc_id, text, planted=True):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = []
    for p in range(1, n // 3 + 1):
        s = None
        for i in range(n - p + 1):
            same = i < n - p and w[i] == w[i + p]
            if same and s is None:
                s = i
            elif not same and s is not None:
                length = i - s + p
                x = w[s : s + length]
                if length >= max(24, 3 * p) and not any(all(x[k] == x[k + q] for k in range(length - q)) for q in range(1, p)):
                    runs.append((s, p, length))
                s = None
    runs.sort()
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    kept = [w[i] for i in range(n) if not any(s + p <= i < s + k for s, p, k in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{k},{p}\n" for s, p, k in runs)), sha(" ".join(kept)))


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            w = [rng.choice("ab") for _ in range(rng.randrange(1, 300))]
        elif kind == 1:
            unit = [f"u{rng.randrange(4)}" for _ in range(rng.randrange(1, 60))]
            w = [f"x{i}" for i in range(rng.randrange(30))] + unit * rng.randrange(2, 9) + unit[: rng.randrange(len(unit))] + [f"y{i}" for i in range(rng.randrange(30))]
        elif kind == 2:
            inner = ["p", "q"] * 14
            w = ([*inner, "z", *(f"v{i}" for i in range(rng.randrange(9)))]) * rng.randrange(1, 6)
        elif kind == 3:
            w = ["same"] * rng.randrange(1, 400)
        elif kind == 4:
            a, b = ["a"], ["b"]
            for _ in range(rng.randrange(3, 8)):
                a, b = a + b, a
            w = a * rng.randrange(1, 5)
        else:
            w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 200))]
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out


SHAPE = "doc_id long, text string, n_runs int, period string, key int"


def rows_of(spark, rows, planted=True):
    d = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], SHAPE).repartition(3)
    return sorted((tuple(r) for r in periods.find_runs(d, planted).drop("runs").collect()), key=repr)


@pytest.mark.parametrize("planted", [False, True])
def test_runs_equal_brute_force(spark, planted):
    rows = list(enumerate(texts(3 + planted, 260)))
    assert rows_of(spark, rows, planted) == sorted((brute(i, t, planted) for i, t in rows), key=repr)


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(4000))
    rows = [(None, None), (None, "a " * 50), (1, None), (2, ""), (3, " \n\t"), (4, long), (5, "x"), (5, "x"), (5, "y " * 30), (25, "a b " * 40), (7, "A a " * 12)]
    assert rows_of(spark, rows) == sorted((brute(i, t) for i, t in rows), key=repr)
    assert rows_of(spark, []) == []


def test_long_run_spans_tiles(spark):
    unit = [f"k{i}" for i in range(700)]
    rows = [(1, " ".join(["h"] * 10 + unit * 12 + unit[:333] + ["t"])), (3, " ".join(["s"] * 9000)), (4, " ".join((["m", "n"] * 20 + ["o"]) * 60))]
    got = {r["doc_id"]: r for r in periods.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(10, 700 * 12 + 333, 700)] and [tuple(r) for r in got[3]["runs"]] == [(0, 9000, 1)]
    assert [tuple(r) for r in got[4]["runs"]] == sorted([(41 * k, 40, 2) for k in range(60)] + [(0, 41 * 60, 41)], key=lambda r: (r[0], r[2]))
