"""Approximate nearest neighbours over learned partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Vectors, drawn by keyed hash of the id, that the partitioning and the classifier are fitted on.
SAMPLE = 6000
#: Parts grow with the vectors, by one for each PART_ROWS of them, from the fewest to the most that the sample can tell apart.
PART_ROWS, FEWEST, MOST = 4096, 4, 96
NEIGHBOURS, SLACK = 10, 1.1
#: Passes of label moves, hidden units, steps and batch of the classifier.
MOVES, HIDDEN, STEPS, BATCH, RATE = 12, 64, 1500, 256, 0.01
#: Queries are routed to as many parts as give this recall on the sample.
RECALL = 0.95
#: Candidates, and queries, of a tile: a quarter of a core's share of the vectors, but no fewer than BLOCK and no more numbers than TILE.
BLOCK, TILE = 2048, 1 << 22
#: Scores that a task holds at once, and tasks that tiles are dealt to at most.
SCORES, MOST_TASKS = 1 << 22, 4096


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that can take part: not null or zero, all numbers finite."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other vectors of each vector."""
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def partition(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Balanced parts that cut few edges of the neighbour graph.

    Starts from equal slices along repeated median cuts by principal direction; then each pass moves nodes to the
    part of most of their neighbours, both ways of an edge counted, best gains first while parts have room.
    """
    n = len(x)
    part = np.zeros(n, np.int64)
    groups, number = [(np.arange(n), parts)], 0
    while groups:
        own, want = groups.pop()
        if want == 1:
            part[own] = number
            number += 1
            continue
        y = x[own] - x[own].mean(axis=0)
        direction = np.linalg.svd(y[:2000], full_matrices=False)[2][0] if len(y) > 1 else np.ones(x.shape[1])
        order = own[np.argsort(y @ direction, kind="stable")]
        left = want // 2
        cut = len(own) * left // want
        groups += [(order[:cut], left), (order[cut:], want - left)]
    most = int(np.ceil(SLACK * n / parts))
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    for _ in range(MOVES):
        near = np.zeros((n, parts))
        np.add.at(near, (a, part[b]), 1)
        best = near.argmax(axis=1)
        gain = near[np.arange(n), best] - near[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def forward(net: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of the parts."""
    return np.maximum(x @ net["w1"] + net["b1"], 0) @ net["w2"] + net["b2"]


def train(x: np.ndarray, target: np.ndarray) -> dict:
    """A network of one hidden layer that predicts in which parts a vector's neighbours lie."""
    rng = np.random.default_rng(1)
    d, k = x.shape[1], target.shape[1]
    net = {"w1": rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)) * np.sqrt(d), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, k)), "b2": np.zeros(k)}
    first, second = {n: np.zeros_like(p) for n, p in net.items()}, {n: np.zeros_like(p) for n, p in net.items()}
    for step in range(1, STEPS + 1):
        own = rng.integers(0, len(x), min(BATCH, len(x)))
        h = np.maximum(x[own] @ net["w1"] + net["b1"], 0)
        out = h @ net["w2"] + net["b2"]
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target[own]) / len(own)
        gh = (g @ net["w2"].T) * (h > 0)
        for n, grad in {"w1": x[own].T @ gh, "b1": gh.sum(axis=0), "w2": h.T @ g, "b2": g.sum(axis=0)}.items():
            first[n] = 0.9 * first[n] + 0.1 * grad
            second[n] = 0.999 * second[n] + 0.001 * grad**2
            net[n] = net[n] - RATE * (1 - step / (STEPS + 1)) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(rows: DataFrame, count: int, nearest: int) -> dict | None:
    """The router: a classifier of vectors into parts and the number of parts to search; None for fewer than ten vectors a part.

    Fitted on at most SAMPLE vectors, which alone reach the driver. Four fifths are partitioned and trained on;
    the others are queries against those, and the parts searched grow until they find RECALL of the nearest.
    """
    got = rows.orderBy(F.xxhash64(F.lit(23), "vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    parts = int(min(MOST, max(FEWEST, -(-count // PART_ROWS))))
    if len(got) < 10 * parts:
        return None  # one part holds them all, and it is searched whole
    x = unit(got.values.to_numpy().reshape(len(got), -1))
    fresh = np.arange(len(x)) % 5 == 0
    base, query = x[~fresh], x[fresh]
    graph = neighbour_graph(base, min(NEIGHBOURS, len(base) - 1))
    part = partition(base, graph, parts)
    target = np.zeros((len(base), parts))
    np.add.at(target, (np.arange(len(base)), part), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(base)), graph.shape[1]), part[graph].ravel()), 1.0)
    net = train(base, target / target.sum(axis=1, keepdims=True))
    at = forward(net, base).argmax(axis=1)
    s = query @ base.T
    true = np.argpartition(-s, nearest - 1, axis=1)[:, :nearest]
    order = np.argsort(-forward(net, query), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(order), 0), 1)
    found = np.sort(np.take_along_axis(rank, at[true], 1).ravel())
    probes = int(found[min(len(found) - 1, int(np.ceil(RECALL * len(found))) - 1)]) + 1
    return {"net": net, "probes": probes}


def routed(rows: DataFrame, router: dict | None, probes: bool) -> DataFrame:
    """(vec_id, v, parts): each row with its likeliest part, or with the parts to search."""
    if router is None:
        return rows.withColumn("parts", F.array(F.lit(0)))
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def task(batches):
        net, k = shared.value["net"], shared.value["probes"] if probes else 1
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v")
                x = unit(v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                top = np.argsort(-forward(net, x), axis=1, kind="stable")[:, :k]
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1], dtype=np.int32)), pa.array(top.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, parts], ["vec_id", "v", "parts"])

    return rows.mapInArrow(task, "vec_id long, v array<double>, parts array<int>")


def tiles(base: DataFrame, asked: DataFrame, side: int, tasks: int) -> DataFrame:
    """(part, b, q, asks, vec_id, v): candidates and queries (asks) of a part in tiles of about side of each, by keyed hash.

    A vector is copied once for each side vectors of the other kind in its part. Tiles are dealt to at least so many
    tasks, each tile whole and its candidates first.
    """
    base, asked = [rows.select("vec_id", "v", F.explode("parts").alias("part")) for rows in (base, asked)]
    high, wide = [{r["part"]: -(-r["count"] // side) for r in rows.groupBy("part").count().collect()} for rows in (base, asked)]  # a row a part
    both = [p for p in high if p in wide]
    of = lambda n: F.coalesce(*[F.when(F.col("part") == p, F.lit(n[p])) for p in both], F.lit(1))
    own = lambda n: F.pmod(F.xxhash64(F.lit(31), "vec_id"), of(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    dealt = lambda rows, b, q, asks: rows.filter(F.col("part").isin(both)).select("part", b.alias("b"), q.alias("q"), F.lit(asks).alias("asks"), "vec_id", "v")
    rows = dealt(base, own(high), each(wide), False).unionByName(dealt(asked, each(high), own(wide), True))
    number = max(tasks, min(MOST_TASKS, sum(high[p] * wide[p] for p in both)))
    return rows.repartition(number, "part", "b", "q").sortWithinPartitions("part", "b", "q", "asks")


def best_of(query_ids, query, ids, base, k):
    """Up to k nearest of ids for each query but itself: (query, id, score), ties to smaller ids.

    A product of matrices finds all that can be among them; their scores are then summed number by number, so
    that a pair has one score wherever it is met.
    """
    qn, bn = np.sqrt((query * query).sum(axis=1)), np.sqrt((base * base).sum(axis=1))
    query_unit, base_unit = query / qn[:, None], (base / bn[:, None]).T
    out, step = [], max(1, SCORES // len(base))
    for begin in range(0, len(query), step):
        s = query_unit[begin : begin + step] @ base_unit
        s[query_ids[begin : begin + step, None] == ids[None, :]] = -np.inf
        for q, row in enumerate(s, begin):
            m = min(k, int(np.isfinite(row).sum()))
            if m:
                least = np.partition(row, -m)[-m]
                near = np.flatnonzero((row >= least - 1e-9) & np.isfinite(row))
                exact = (base[near] * query[q]).sum(axis=1) / (bn[near] * qn[q])
                first = np.lexsort((ids[near], -exact))[:m]
                out.append((np.full(m, query_ids[q]), ids[near][first], exact[first]))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors by cosine.

    Every vector is indexed in its likeliest part; a query searches its likeliest parts, so it can miss a
    neighbour. Rows of the query's own id are no candidates. Vectors that are null, zero, of another length than
    most, or hold nulls or non-finite numbers take no part. Ids should be unique; of repeated ones each row
    counts. Few vectors make one part, and the search is exact. Other columns are left out.
    """
    fine = usable(vectors)
    top = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = F.size("v") == (top["n"] if top else 0)  # of vectors and queries alike
    rows = materialize(fine.filter(length))
    count = rows.count()
    router = fit(rows, count, k)
    base = materialize(routed(rows, router, False))
    asked = materialize(routed(usable(queries).filter(length), router, True))
    discard(rows)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    side = max(1, min(TILE // max(1, top["n"] if top else 1), max(BLOCK, count // (4 * cores))))

    def task(batches):
        tile, held, base = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in ("part", "b", "q")], axis=1)
            asks, ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "vec_id")]
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                if tile != tuple(at[i]):
                    tile, held, base = tuple(at[i]), [], None
                if not asks[i]:
                    held.append((ids[i:j], v[i:j]))
                    continue
                if held:
                    base, held = [np.concatenate(c) for c in zip(*held)], []
                got = best_of(ids[i:j], v[i:j], *base, k) if base else None
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])

    near = tiles(base, asked, side, max(8, cores * 2)).mapInArrow(task, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))
