"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize, table


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """One row a source with its target: share of all words dealt by weight, at most epochs times the source.

    sizes has (source, source_size). Sources come by code point, null last, and the weights repeat over them.
    The level at which weights are filled is found from the sources' ratios of cap to weight in order: a source
    is capped when its ratio lies below the level that is left for it and those after it.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(every) - 1) % len(weights) + 1).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    w = w.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    w = w.withColumn("fill", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole))
    w = w.withColumn("target", F.least("cap", F.coalesce(F.col("fill") * F.col("weight"), F.col("cap"))))
    return w.select("source", "source_size", "weight", "target")


def sized(docs: DataFrame, *carry: str, seed: int = 11) -> DataFrame:
    """docs (doc_id, source, text) with size and _h, the keyed hash by which a source is shuffled; text goes unless carried."""
    rows = docs.select("doc_id", "source", *carry, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size"))


def place() -> Column:
    """A row's place in its source's queue, comparable; a null doc_id comes first."""
    return F.struct(F.col("_h").alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.col("size").alias("n"))


def ranged(rows: DataFrame, *order) -> DataFrame:
    """rows sorted over all tasks by order, stored, with _part: the number of the range that a row lies in."""
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def queue(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target, cuts, edge): how far down its queue each source is taken, a row a source, stored.

    rows are those of sized. Rows of a source are shuffled by a keyed hash and passed up to `epochs` times. A
    row's virtual finish time in a pass is the source's cumulative words divided by its target. All passes of all
    rows are range-sorted by finish time over all tasks and cut off where share * all words are full. Running sums
    are those inside a range and what lies in the ranges before it. As finish times grow along a source's queue, the
    cut is a place in it for each pass: cuts[k] is the last place that is taken whole in pass k, and edge the
    place that gives only got words.
    """
    rows = materialize(rows.select("doc_id", "source", "size", "_h"))
    plan = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs))
    by_source = ranged(rows.filter("size > 0"), F.col("source").asc_nulls_last(), "_h", "doc_id", "size")
    sums = by_source.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("source").orderBy("_part")) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("source", "_part").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_source.alias("d").join(before.alias("s"), F.expr("d.source <=> s.source and d._part = s._part")).select("d.*", "s._before")
    ends = ends.withColumn("_end", F.col("_before") + F.sum("size").over(inside)).drop("_part", "_before")
    ends = ends.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source")).select("d.*", "p.source_size", "p.target")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("_end") + F.lit(k) * F.col("source_size")) / F.col("target")).alias("v")) for k in range(epochs)]))
    passes = ends.withColumn("_p", each).select("_p.v", "source", place().alias("at"), "_p.k")
    order = (F.col("v"), F.col("source").asc_nulls_last(), F.col("at"), F.col("k"))
    passes = ranged(passes, *order)
    parts = passes.groupBy("_part").agg(F.sum("at.n").alias("w")).orderBy("_part").collect()  # a row a range
    budget, left, cut = int(sum(r["w"] for r in parts) / epochs * share), 0, None
    for r in parts:
        if left + r["w"] > budget:
            cut = r["_part"]
            break
        left += r["w"]
    whole = passes
    edge = None
    if cut is not None:
        upto = F.sum("at.n").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(left)
        edge = passes.filter(F.col("_part") == cut).withColumn("upto", upto).filter(F.col("upto") > budget).orderBy("upto").first()
        same = F.expr("source is null") if edge["source"] is None else F.col("source").eqNullSafe(F.lit(edge["source"]))
        there = F.struct(*[F.lit(edge["at"][f]).cast("long").alias(f) for f in "hdn"])
        # rows that are equal in id and size share a place and what it gets
        here = passes.filter(same & (F.col("k") == edge["k"]) & (F.col("at") == there)).agg(F.count("*").alias("rows"), F.count(F.when(F.col("v") < edge["v"], 1)).alias("full")).first()
        got = (here["full"] * edge["at"]["n"] + budget - edge["upto"] + edge["at"]["n"]) // here["rows"]
        later_name = F.lit(False) if edge["source"] is None else F.col("source").isNull() | (F.col("source") > F.lit(edge["source"]))
        after = (F.col("v") > edge["v"]) | ((F.col("v") == edge["v"]) & (later_name | (same & (F.col("at") >= there))))
        whole = passes.filter(~F.coalesce(after, F.lit(False)) & ~(same & (F.col("k") == edge["k"]) & (F.col("at") == there)))
    cuts = whole.groupBy("source").agg(*[F.max(F.when(F.col("k") == k, F.col("at"))).alias(f"c{k}") for k in range(epochs)])
    out = plan.alias("p").join(cuts.alias("c"), F.expr("p.source <=> c.source"), "left")
    none = F.lit(None).cast("struct<k:int,at:struct<h:bigint,d:bigint,n:bigint>,got:bigint>")
    last = none if edge is None else F.when(F.expr("p.source is null") if edge["source"] is None else F.expr("p.source").eqNullSafe(F.lit(edge["source"])), F.struct(F.lit(edge["k"]).alias("k"), there.alias("at"), F.lit(got).cast("long").alias("got")))
    out = materialize(out.select("p.source", "p.source_size", "p.target", F.array(*[f"c.c{k}" for k in range(epochs)]).alias("cuts"), F.coalesce(last, none).alias("edge")))
    discard(rows, plan, by_source, passes)
    return out


def take(rows: DataFrame, queues: DataFrame) -> DataFrame:
    """rows of sized with source_size, target and taken, by the queues' cuts: no row meets another row for it."""
    met = rows.withColumn("_at", place()).alias("r").join(queues.alias("q"), F.expr("r.source <=> q.source"))
    full = F.size(F.filter("q.cuts", lambda c: c.isNotNull() & (F.col("_at") <= c)))
    rest = F.when((F.col("_at") == F.col("q.edge.at")), F.col("q.edge.got")).otherwise(0)
    taken = F.when(F.col("size") > 0, full * F.col("size") + F.coalesce(rest, F.lit(0))).otherwise(0).cast("long")
    return met.select(*[f"r.{c}" for c in rows.columns if c != "_h"], "q.source_size", "q.target", taken.alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 11, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of docs with size, source_size, target and taken: the words that the mixture takes from it.

    Null and blank texts have size 0 and give 0 words; a null source is a source of its own. Repeated rows count
    as rows; those that share id and size at the very limit share what it gets evenly. An empty table gives an
    empty table. Columns besides those named in carry are left out.
    """
    rows = materialize(sized(docs, *carry, seed=seed))
    return take(rows, queue(rows, weights, share, epochs))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")
