"""Hard negatives within score windows, from candidate blocks along a Hilbert curve with zone maps.

Candidates are stored in blocks of one label, in the order of a Hilbert curve through their quantised vectors, so
that a block's vectors lie near each other. A block's zone map has the least and greatest value of each dimension,
and interval arithmetic bounds from it every inner product with an anchor. A search takes two turns: the blocks of the
highest bounds give each window a score that its last place reaches at least, then all blocks that can hold a better
one are read. Bounds never leave out a row, so results are exact whatever the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Rows of a candidate block, anchors of a pack and zone maps of a page.
BLOCK, PACK, PAGE = 1024, 512, 4096
#: The curve goes through the dimensions of the greatest variance, each cut into 2 ** BITS parts.
CURVE, BITS = 16, 4
#: Blocks that the first turn reads for an anchor.
EARLY = 2
LEAST, MOST = -(1 << 63), (1 << 63) - 1

WINDOWS = "windows array<struct<place:int,low:long,high:long>>"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, q being floor(256 * x) of each component."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * 256)).alias("q"))


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places of points, a row each of whole numbers below 2 ** bits, along the Hilbert curve; bits * dimensions is 64 at most."""
    x = x.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    last = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        last ^= np.where((x[-1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= last
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key


def spread(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dimensions of the greatest variance, and the least value and width of each; only a row a dimension reaches the driver."""
    each = rows.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.var_pop(F.col("x").cast("double")).alias("var"))
    got = sorted(each.collect(), key=lambda r: (-r["var"], r["d"]))[:CURVE]
    low = np.array([r["low"] for r in got], float)
    return np.array([r["d"] for r in got], int), low, np.maximum(np.array([r["high"] for r in got], float) - low, 1.0)


def blocks_of(rows: DataFrame) -> DataFrame:
    """A stored table of (block, label, n, low, high, ids, bytes, packed): rows of one label that are neighbours on the curve.

    low and high are the zone map; packed has the vectors in whole numbers of as many bytes as they need.
    """
    dims, low, width = spread(rows)

    def along(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("q"))[:, dims]
                cell = np.clip((x - low) / width * (1 << BITS), 0, (1 << BITS) - 1)
                key = (hilbert(cell, BITS) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    def packed(batches):
        held, label, n = [], None, 0

        def block():
            ids = np.concatenate([h[0] for h in held])
            q = np.concatenate([h[1] for h in held])
            lo, hi = q.min(axis=0), q.max(axis=0)
            size = next(b for b in (2, 4, 8) if -(1 << (8 * b - 1)) <= lo.min() and hi.max() < 1 << (8 * b - 1))
            cols = [pa.array([label], pa.int64()), pa.array([len(ids)], pa.int64()), *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in (lo, hi, ids)), pa.array([size], pa.int32()), pa.array([q.astype(f"<i{size}").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["label", "n", "low", "high", "ids", "bytes", "packed"])

        for batch in batches:
            labels, ids = batch.column("label").to_numpy(), batch.column("vec_id").to_numpy()
            q = matrix(batch.column("q")) if batch.num_rows else None
            at = 0
            while at < len(labels):
                if n and (labels[at] != label or n == BLOCK):
                    yield block()
                    held, n = [], 0
                label = int(labels[at])
                other = np.flatnonzero(labels[at : at + BLOCK - n] != label)
                end = at + (int(other[0]) if len(other) else min(BLOCK - n, len(labels) - at))
                held.append((ids[at:end], q[at:end]))
                n += end - at
                at = end
        if n:
            yield block()

    keyed = rows.mapInArrow(along, "vec_id long, label long, q array<long>, key long")
    tasks = max(8, rows.sparkSession.sparkContext.defaultParallelism * 2)
    ordered = keyed.repartitionByRange(tasks, "label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id")
    made = ordered.mapInArrow(packed, "label long, n long, low array<long>, high array<long>, ids array<long>, bytes int, packed binary")
    return materialize(made.withColumn("block", F.monotonically_increasing_id()))


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner product that rows of q can have with vectors between low and high, rounding included."""
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T * (q.shape[1] * 2.0**-50)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits become the nearest 64-bit number."""
    most = int(np.abs(q.astype(float)).max(initial=0) + 1) * int(np.abs(v.astype(float)).max(initial=0) + 1) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(float) @ v.T.astype(float)).astype(np.int64)
    return np.clip(q.astype(object) @ v.T.astype(object), LEAST, MOST).astype(np.int64)


def packs_of(anchors: DataFrame) -> DataFrame:
    """Anchors, a row each of (anchor, anchor_id, label, q, windows, need), about PACK to a row; need: a score for each window that a result must reach."""
    packs = max(1, -(-anchors.count() // PACK))
    entry = F.struct("anchor", "anchor_id", "label", "q", "windows", "need")
    return materialize(anchors.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(packs)).alias("pack")).agg(F.collect_list(entry).alias("anchors")))


def opened(entries: pa.Array) -> dict:
    """The anchors of a pack as matrices; windows as flat columns, owner being the anchor of each."""
    e = entries.values if isinstance(entries, pa.ListScalar) else entries
    windows = e.field("windows")
    flat, need = windows.flatten(), e.field("need").flatten()
    owner = np.repeat(np.arange(len(e)), windows.value_lengths().to_numpy())
    numbers = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "low", "high")}
    return {c: e.field(c).to_numpy() for c in ("anchor", "anchor_id", "label")} | numbers | {"q": matrix(e.field("q")), "owner": owner, "need": need.to_numpy(zero_copy_only=False)}


def choose(packs: DataFrame, blocks: DataFrame, same: bool, early: bool) -> DataFrame:
    """(pack, block, anchors): the blocks that bounds say an anchor's windows must read; early: EARLY of the best of them for each."""
    zones = blocks.select("block", "label", "low", "high")
    pages = max(1, -(-zones.count() // PAGE))
    paged = zones.groupBy(F.pmod("block", F.lit(pages)).cast("int").alias("page")).agg(F.collect_list(F.struct("block", "label", "low", "high")).alias("zones"))
    met = packs.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))).join(paged, "page")

    def task(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, zones = opened(batch.column("anchors")[r]), batch.column("zones")[r].values
                label, number = zones.field("label").to_numpy(), zones.field("block").to_numpy()
                least, most = bounds(a["q"].astype(float), matrix(zones.field("low")).astype(float), matrix(zones.field("high")).astype(float))
                alike = a["label"][:, None] == label[None, :]
                floor = np.maximum(a["low"], a["need"]).astype(float)
                fits = (most[a["owner"]] >= floor[:, None]) & (least[a["owner"]] <= a["high"].astype(float)[:, None])
                wanted = np.zeros(most.shape, bool)
                np.logical_or.at(wanted, a["owner"], fits)
                wanted &= alike if same else ~alike
                x, z = np.nonzero(wanted)
                if early and len(x):
                    order = np.lexsort((number[z], -most[x, z], x))
                    x, z = x[order], z[order]
                    keep = np.arange(len(x)) - np.searchsorted(x, x) < EARLY
                    x, z = x[keep], z[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), batch.column("pack")[r].as_py()), pa.int64()), pa.array(number[z], pa.int64()), pa.array(a["anchor"][x], pa.int64()), pa.array(most[x, z], pa.float64())], ["pack", "block", "anchor", "bound"])

    pairs = met.select("pack", "anchors", "zones").mapInArrow(task, "pack long, block long, anchor long, bound double")
    if early:
        best = Window.partitionBy("anchor").orderBy(F.desc("bound"), "block")
        pairs = pairs.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= EARLY)
    return pairs.groupBy("pack", "block").agg(F.collect_list("anchor").alias("chosen"))


def read(pairs: DataFrame, packs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(anchor, place, turn, id, score): the first k rows of chosen blocks in each window of each anchor."""

    def task(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, ids = opened(batch.column("anchors")[r]), batch.column("ids")[r].values.to_numpy()
                v = np.frombuffer(batch.column("packed")[r].as_buffer(), f"<i{batch.column('bytes')[r].as_py()}").reshape(len(ids), -1)
                own = np.flatnonzero(np.isin(a["anchor"], batch.column("chosen")[r].values.to_numpy()))
                place = np.full(len(a["anchor"]), -1)
                place[own] = np.arange(len(own))
                s = products(a["q"][own], v)
                out = []
                for w in np.flatnonzero(place[a["owner"]] >= 0):
                    x = a["owner"][w]
                    row = s[place[x]]
                    fit = np.flatnonzero((row >= max(a["low"][w], a["need"][w])) & (row <= a["high"][w]) & (ids != a["anchor_id"][x]))
                    fit = fit[np.lexsort((ids[fit], -row[fit].astype(object) if (row[fit] == LEAST).any() else -row[fit]))][:k]
                    out.append((np.full(len(fit), a["anchor"][x]), np.full(len(fit), a["place"][w]), ids[fit], row[fit]))
                if out:
                    anchor, at, found, score = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(at, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], ["anchor", "place", "id", "score"])

    met = pairs.join(packs, "pack").join(blocks.select("block", "ids", "bytes", "packed"), "block")
    tasks = max(8, pairs.sparkSession.sparkContext.defaultParallelism * 2)
    near = met.select("anchors", "chosen", "ids", "bytes", "packed").repartition(tasks).mapInArrow(task, "anchor long, place int, id long, score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return near.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= k)


def search(anchors: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, place, turn, id, score): in each of an anchor's windows the k highest scores of rows of its label or of other labels.

    anchors: a stored table of (anchor, anchor_id, label, q, windows).
    """
    none = anchors.withColumn("need", F.transform("windows", lambda w: F.lit(LEAST)))
    packs = packs_of(none)
    some = read(choose(packs, blocks, same, early=True), packs, blocks, k)
    last = some.filter(F.col("turn") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("reached"))
    known = anchors.join(last, "anchor", "left").withColumn("need", F.transform("windows", lambda w: F.coalesce(F.element_at("reached", w["place"]), F.lit(LEAST))))
    full = packs_of(known.drop("reached"))
    discard(packs)
    out = materialize(read(choose(full, blocks, same, early=False), full, blocks, k))
    discard(full)
    return out


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors and anchors have vec_id, label and embedding; anchors are rows of vectors. Scores are inner products of
    floor(256 * x). An anchor's positives are the first rows of its label, negatives of each the first of other labels
    whose score is low to high per cent of the positive's; higher scores come first, ties by smaller vec_id. Rows of
    the anchor's own id are neither. Rows with a null id or label, with a null or empty vector, a null or non-finite
    component, or of another length than most vectors take no part. Of repeated ids each row counts. A positive of
    negative score has an empty window. Numbers beyond 64 bits count as the nearest one. Other columns are left out.
    """
    fine = usable(vectors)
    top = fine.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = F.size("q") == (top["n"] if top else 0)
    blocks = blocks_of(fine.filter(length)) if top else None
    asked = materialize(usable(anchors).filter(length).select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q"))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not top:
        return vectors.sparkSession.createDataFrame([], result)
    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    found = search(asked.withColumn("windows", whole), blocks, True, positives)
    found = found.select("anchor", F.col("turn").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score").cast("decimal(20,0)")
    edge = lambda share, up: ((score * share + (F.pmod(-score * share, F.lit(100)) if up else -F.pmod(score * share, F.lit(100)))) / 100).cast("decimal(38,0)").cast("long")
    ends = found.withColumn("low", edge(low, True)).withColumn("high", edge(high, False)).filter("low <= high")
    windows = ends.groupBy("anchor").agg(F.collect_list(F.struct("place", "low", "high")).alias("windows"))
    got = search(materialize(asked.join(windows, "anchor")), blocks, False, negatives)
    named = got.join(found, ["anchor", "place"]).join(asked.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", F.col("turn").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, vectors.filter("vec_id % 100 = 0"))
