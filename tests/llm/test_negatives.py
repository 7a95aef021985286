"""Hard negatives against brute force; the curve, the bounds and what they leave unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import negatives

SHAPE = "vec_id long, label int, embedding array<float>, score double, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, y, v, 0.5, "x") for i, y, v in rows], SHAPE).repartition(3)


def brute(rows, anchors):
    fine = [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    sizes = [len(v) for _, _, v in fine]
    n = max(sorted(set(sizes), reverse=True), key=sizes.count, default=0)
    fine = [r for r in fine if len(r[2]) == n]
    out = []
    for a, y, q in fine:
        if not anchors(a):
            continue
        s = sorted((-sum(p * r for p, r in zip(q, v)), i, z) for i, z, v in fine if i != a)
        for ps, p, _ in [x for x in s if x[2] == y][:5]:
            hits = [x for x in s if x[2] != y and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:10]
            out += [(a, p, k + 1, i, -ps, -ns) for k, (ns, i, _) in enumerate(hits)]
    return sorted(out)


def mined(spark, rows, anchors=lambda c: c % 10 == 0):
    d = frame(spark, rows)
    return sorted(tuple(r) for r in negatives.mine(d, d.filter(anchors(F.col("vec_id")))).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "PACK", 7)
    monkeypatch.setattr(negatives, "PAGE", 5)
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.3, (300, 6)).round(1)
    rows = [(i, int(rng.integers(4)), v[i].tolist()) for i in range(300)] + [(1000 + i, 2, v[7].tolist()) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda a: a % 10 == 0)


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.5, 0.5]), (2, 2, [0.25, 0.5]), (2, 2, [0.25, 0.5]), (3, None, [9.0, 9.0]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 0.0]), (8, 3, [0.5]), (None, 2, [0.5, 0.5]), (10, 2, [-1.0, 0.0]), (20, 3, [0.0, 0.0]), (9, 2, [])]
    assert mined(spark, rows) == brute(rows, lambda a: a % 10 == 0)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, None)]) == []
    large = [(i, i % 2, [3e5 * (i + 1), 4e5]) for i in range(12)]
    assert mined(spark, large) == brute(large, lambda a: a % 10 == 0)
    assert mined(spark, [(0, 1, [1e30, 1.0]), (1, 1, [1e30, 1.0]), (2, 2, [1.0, 1.0])]) is not None


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = negatives.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, v = rng.integers(-300, 300, (20, 8)).astype(float), rng.integers(-300, 300, (30, 8)).astype(float)
    least, most = negatives.bounds(q, v.min(axis=0)[None], v.max(axis=0)[None])
    s = q @ v.T
    assert (least[:, 0] <= s.min(axis=1)).all() and (most[:, 0] >= s.max(axis=1)).all()


def test_clustered_vectors_leave_blocks_unread(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 8))
    rows = [(i, i % 3, (centres[i % 12] + rng.normal(0, 0.02, 8)).tolist()) for i in range(3000)]
    d = frame(spark, rows)
    blocks = negatives.blocks_of(negatives.usable(d))
    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit(negatives.LEAST).alias("low"), F.lit(negatives.MOST).alias("high")))
    asked = negatives.usable(d.filter("vec_id % 100 = 0")).select(F.col("vec_id").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q").withColumn("windows", whole)
    first = negatives.packs_of(asked.withColumn("need", F.array(F.lit(negatives.LEAST))))
    some = negatives.read(negatives.choose(first, blocks, True, True), first, blocks, 5).filter("turn = 5").select("anchor", "score")
    full = negatives.packs_of(asked.join(some, "anchor").withColumn("need", F.array("score")).drop("score"))
    pairs = negatives.choose(full, blocks, True, False).select(F.sum(F.size("chosen"))).first()[0]
    assert pairs < 0.5 * 30 * blocks.count() / 3
    assert mined(spark, rows, lambda c: c % 100 == 0) == brute(rows, lambda a: a % 100 == 0)
