"""Periodic runs of words: documents tiled once an octave of periods, fragments stitched by document and period.

A run of period p repeats its words at distance p over 2 p places at least. An octave of periods [P, 2 P) cuts a
document's words at every multiple of P, so such a stretch holds a whole block of P words after a boundary, and that
block is found again p words on. Rolling hashes tell which boundaries have such a block; the tiles around them are rows
of their own, dealt over all tasks. In a tile the Z-functions of what stands behind and before a boundary give the
exact stretch of each period; stretches of one document and period that meet are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _BYTE, _SEP, discard, materialize, mix, powers, steps, table, text_buffers, word_hashes

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Boundary distance and periods [low, high) of the first octave; each further one is [high, 2 * high) at distance high.
#: A run of a period under 16 repeats its words over 16 places or more, which hold a whole block of 8.
FIRST = (8, 1, 16)
#: Boundaries in a tile.
TILE = 16

FOUND = "key long, octave int, first long, boundaries array<int>, words array<long>, n long, doc_id long, text string, planted boolean, collapsed string"


def planting(doc_id, n: int) -> tuple[int, int] | None:
    """(a, p) if the words from a on repeat the p words there."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return (a := g % n, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def order_of(n: int, planted: tuple[int, int] | None) -> np.ndarray:
    """Which of its original words stands at each place of a document."""
    at = np.arange(n)
    if planted:
        a, p = planted
        at[a:] = a + (at[a:] - a) % p
    return at


def octaves(n: int):
    block, low, high = FIRST
    while TIMES * low <= n and n >= LEAST:
        yield block, low, high
        block, low, high = high, high, 2 * high


def boundaries(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the boundaries whose block of words is found again low to high - 1 words on, by rolling hashes."""
    up, down = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    rolling = (sums[block:] - sums[:-block]) * down[: len(words) - block + 1]
    each = np.maximum((ends - begins - block - low) // block + 1, 0)
    own = np.repeat(np.arange(len(begins)), each)
    at = (np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)) * block + begins[own]
    keep = np.zeros(len(at), bool)
    for i in range(0, len(at), rows := max(1, (1 << 20) // (high - low))):
        b = at[i : i + rows]
        there = b[:, None] + np.arange(low, high)
        inside = there + block <= ends[own[i : i + rows], None]
        keep[i : i + rows] = ((rolling[np.minimum(there, len(rolling) - 1)] == rolling[b][:, None]) & inside).any(axis=1)
    return own[keep], at[keep]


def z_function(s: list) -> list:
    """The length of the longest common prefix of s and each of its suffixes."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def fragments(words: list, b: int, block: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(period, start, end) near boundary b: places i with words[i] == words[i + period], from one block before b to two after.

    Only stretches that hold b's whole block count, and none whose words have a period that divides this one.
    """
    begin = max(0, b - block)
    after = words[b : b + 2 * block + high]
    ahead = z_function(after)  # what repeats from b on
    back = words[begin:b][::-1]
    mirror = z_function([*back, None, *words[begin : b + high][::-1]])
    reach = len(words[begin : b + high])

    def behind(p: int) -> int:
        """How many words before b are those before b + p."""
        i = len(back) + 1 + reach - (b + p - begin)
        return min(mirror[i], len(back)) if b + p - begin <= reach else 0

    out = []
    for p in range(low, min(high, len(after))):
        if ahead[p] < block:
            continue
        right, left = min(ahead[p], 2 * block), behind(p)
        if not any(ahead[q := p // f] >= right + p - q and behind(q) >= left for f in prime_factors(p)):
            out.append((p, b - left, b + right))
    return out


def joined(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches of one period that meet as one."""
    out: list[tuple[int, int, int]] = []
    for p, s, e in sorted(found):
        if out and out[-1][0] == p and s <= out[-1][2]:
            out[-1] = (p, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((p, s, e))
    return out


def tiles(docs: DataFrame, planted: bool) -> DataFrame:
    """A row for each text (octave 0) and one for each of its tiles that may hold part of a run.

    The row of a text without tiles has its final collapsed digest; that of others their text.
    """

    def task(batches):
        for batch in batches:
            ids, keys, column = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")
            data, offsets = text_buffers(column)
            for i, j in steps(offsets):
                yield solved(ids[i:j], keys[i:j], column.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def solved(ids, keys, column, data, offsets):
        words, counts = word_hashes(data, offsets, _SEP, _BYTE)
        ends = np.cumsum(counts)
        begins = ends - counts
        plan = [planting(d, int(n)) if planted else None for d, n in zip(ids, counts)]
        for d, p in enumerate(plan):
            if p:
                words[begins[d] : ends[d]] = words[begins[d] : ends[d]][order_of(int(counts[d]), p)]
        rows = []
        for block, low, high in octaves(int(counts.max(initial=0))):
            of, at = boundaries(words, begins, ends, block, low, high)
            place = at - begins[of]
            tile = place // (block * TILE)
            cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (tile[1:] != tile[:-1])])) if len(of) else np.zeros(0, int)
            for k, e in zip(cut, [*cut[1:], len(of)]):
                d, first = of[k], max(0, int(place[k]) - block)
                last = min(int(counts[d]), int(place[e - 1]) + 2 * block + high)
                rows.append((int(d), high, first, (place[k:e] - first).astype(np.int32), words[begins[d] + first : begins[d] + last].view(np.int64)))
        some = np.zeros(len(ids), bool)
        some[[r[0] for r in rows]] = True
        texts = column.to_pylist()
        collapsed = [None if some[d] else hashlib.sha256(b" ".join(shown(texts[d], plan[d]))).hexdigest() for d in range(len(ids))]
        n, none = len(ids), [None] * len(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*keys, *[keys[r[0]] for r in rows]], pa.int64()),
                pa.array([0] * n + [r[1] for r in rows], pa.int32()),
                pa.array([0] * n + [r[2] for r in rows], pa.int64()),
                pa.array([None] * n + [r[3] for r in rows], pa.list_(pa.int32())),
                pa.array([None] * n + [r[4] for r in rows], pa.list_(pa.int64())),
                pa.array([*counts.tolist(), *none], pa.int64()),
                pa.array([*ids, *none], pa.int64()),
                pa.array([*[t if s else None for t, s in zip(texts, some)], *none], pa.string()),
                pa.array([*[p is not None for p in plan], *none], pa.bool_()),
                pa.array([*collapsed, *none], pa.string()),
            ],
            ["key", "octave", "first", "boundaries", "words", "n", "doc_id", "text", "planted", "collapsed"],
        )

    return docs.mapInArrow(task, FOUND)


def shown(text: str | None, planted: tuple[int, int] | None) -> list[bytes]:
    """The words of a text, repeated as planted."""
    words = (text or "").encode().split()
    if planted:
        a, p = planted
        words[a:] = (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]
    return words


def solve(found: DataFrame) -> DataFrame:
    """(key, period, start, end) of the stretches in tiles, found by the Z-functions at each tile's boundaries."""

    def task(batches):
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = FIRST[0] if row["octave"] == FIRST[2] else row["octave"] // 2
                low = FIRST[1] if row["octave"] == FIRST[2] else block
                near = [f for b in row["boundaries"] for f in fragments(row["words"], b, block, low, row["octave"])]
                out += [(row["key"], p, s + row["first"], e + row["first"]) for p, s, e in joined(near)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "period", "start", "end"])

    spread = found.repartition(F.xxhash64("key", "octave", "first"))
    return spread.mapInArrow(task, "key long, period long, start long, end long")


def stitch(stretches: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs that stretches of one document and period make together."""
    near = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(near.rowsBetween(Window.unboundedPreceding, -1))
    part = stretches.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("part", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    whole = part.groupBy("key", "period", "part").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("same"))
    return whole.select("key", "start", (F.col("same") + F.col("period")).alias("length"), "period").filter(f"length >= greatest({LEAST}, {TIMES} * period)")


def find_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, runs_sha256, collapsed_sha256), a row for each row of docs.

    A run is a stretch of words with smallest period q, of max(24, 3 q) words or more, that no neighbour extends;
    runs has all (start, length, period) by start, then period. start, length, period and exponent_milli are of the run
    of the greatest length / period, exactly compared (ties: smaller start, then period), null without runs. collapsed:
    the words that no run holds after its first period, joined by a space. planted: repeats the words of a tenth of
    the documents first, as h = crc32(doc_id) tells; rows without an id are left alone. Words are the runs of
    bytes other than spaces, tab to carriage return, and are compared by 64-bit hashes; null and empty texts have
    none. Rows may repeat ids or texts; other columns are left out.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.monotonically_increasing_id())
    found = materialize(tiles(keyed, planted))
    runs = stitch(solve(found.filter("octave > 0").select("key", "octave", "first", "boundaries", "words")))
    by_text = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = found.filter("octave = 0").select("key", "n", "doc_id", "text", "planted", "collapsed")
    plain = texts.filter("collapsed is not null").withColumn("runs", F.lit(None).cast("array<struct<start:long,period:long,length:long>>"))
    some = texts.filter("collapsed is null").join(by_text, "key", "left")

    def task(batches):
        for batch in batches:
            out = [described(batch.slice(i, 1).to_pylist()[0]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs", pa.list_(run)), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    shape = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed_sha256 string"
    return plain.unionByName(some).mapInArrow(task, shape)


def described(row: dict) -> dict:
    runs = row["runs"] or []
    out = {"doc_id": row["doc_id"], "n_runs": len(runs), "runs": runs}
    out["runs_sha256"] = hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs).encode()).hexdigest()
    best = None
    for r in runs:  # by start, then period: a later one must be truly greater
        if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
    if best:
        out |= {"start": best["start"], "length": best["length"], "period": best["period"], "exponent_milli": 1000 * best["length"] // best["period"]}
    if row["collapsed"] is None:
        words = shown(row["text"], planting(row["doc_id"], row["n"]) if row["planted"] else None)
        drops = np.zeros(len(words) + 1, np.int64)
        for r in runs:
            drops[r["start"] + r["period"]] += 1
            drops[r["start"] + r["length"]] -= 1
        keep = np.flatnonzero(np.cumsum(drops[:-1]) == 0)
        out["collapsed_sha256"] = hashlib.sha256(b" ".join([words[i] for i in keep])).hexdigest()
    else:
        out["collapsed_sha256"] = row["collapsed"]
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), planted=True).drop("runs")
