"""N-gram Jaccard join: universe partitions and the pigeonhole principle, verified exactly.

The shingles of a set fall by hash into the m segments of its size band. Two sets whose Jaccard similarity reaches
the threshold differ in at most H shingles, H following from their sizes, so at least m - H segments are equal in
both. Which segments a set is indexed by is a matter of cost: the H + 1 whose signatures the fewest sets have. Signatures
are ranked alike for all sets, so two linked sets share at least one that both are indexed by. A set whose cheap
segments have signatures of its own is met by nobody. Small bands have half as many segments, each indexed by its
one-deletion neighbourhood, as one of H // 2 + 1 segments has one difference at most.

Buckets are met in three turns: every row with one row of its bucket, which joins groups of near copies into
components; then rows of different components, whose difference is first bounded by parity sketches, by as few
pairs as would join all that the sketches leave open; then all open pairs of rows that are still apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_ids, connected_components, discard, materialize, mix, salted_lookup, steps, table, text_buffers, with_values, word_hashes

#: Size bands: each ends at RATIO times where it begins.
RATIO = 1.5
#: Segments besides the H + 1 that are needed, which a set may leave out: so many, and one for so many needed.
SPARE, SPARE_SHARE = 4, 6
#: Bands in which sets differ in so many shingles at most are indexed by one-deletion neighbourhoods.
DELETIONS = 3
#: Rows of a bucket that one task compares with as many others.
BLOCK = 1024
#: Pairs with one row that one task verifies.
PAIRS = 2000


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


class Plan:
    """Size bands and their segments for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low, ends = 1, []
        while low < 1 << 40:
            ends.append(max(low, int(low * RATIO)))
            low = ends[-1] + 1
        self.ends = np.array(ends, dtype=np.int64)
        most = self.differences(self.ends, self.ends * den // num)
        self.near = most <= DELETIONS
        self.segments = np.where(self.near, most // 2 + 1, most + 1 + SPARE + most // SPARE_SHARE)

    def differences(self, r, s):
        """The most shingles in which linked sets of sizes r and s differ: D <= (den - num) * (r + s) / (den + num)."""
        return (self.den - self.num) * (r + s) // (self.den + self.num)

    def band(self, size):
        return np.searchsorted(self.ends, size)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of some texts, text after text, and the sets' sizes.

    A text of fewer words than width has its whole sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(data, offsets)
    n = len(words)
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(ends, counts) - np.arange(n)  # words from here to the text's end
    h = np.zeros(n, np.uint64)
    for k in range(width):
        part = words * (mix(np.full(1, (k + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF, np.uint64))[0] | u64(1))
        h[: n - k] += np.where(left[: n - k] > k, part[k:], u64(k * 0x632BE59BD9B4E019 + 1)) if n > k else 0
        if k:
            h[max(0, n - k) :] += u64(k * 0x632BE59BD9B4E019 + 1)
    first = np.zeros(n, dtype=bool)
    first[(ends - counts)[counts > 0]] = True
    keep = (left >= width) | (first & (np.repeat(counts, counts) < width))
    h, doc = mix(h[keep]), doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def grouped_sum(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of values by their group, which is sorted."""
    out = np.zeros(n, np.uint64)
    if len(values):
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[begin]] = np.add.reduceat(values, begin)
    return out


def signatures(h: np.ndarray, sizes: np.ndarray, band: np.ndarray, plan: Plan, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, slack) of the sets in their bands; slack: how many of its signatures the set can leave out.

    lower: the sets are from the band above and look there for smaller ones.
    """
    sets = np.flatnonzero((sizes > 0) & (band >= 0))
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.repeat((sizes > 0) & (band >= 0), sizes)
    h, size, band = h[inside], sizes[sets], band[sets]
    own = np.repeat(np.arange(len(sets)), size)
    m = plan.segments[band]
    start = np.cumsum(m) - m
    segment = start[own] + (mix(h ^ u64(0x5851F42D4C957F2D)) % m[own].astype(np.uint64)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], mix(h[order] + u64(0x2545F4914F6CDD1D))
    full = grouped_sum(value, segment, int(m.sum()))
    owner = np.repeat(np.arange(len(sets)), m)
    number = np.arange(len(owner)) - start[owner]
    salt = mix((band[owner].astype(np.uint64) << u64(40)) + number.astype(np.uint64) + u64(1))
    partner = np.minimum(size, plan.ends[band]) if lower else size * plan.den // plan.num
    slack = np.where(plan.near[band], 0, np.maximum(m - plan.differences(partner, size) - 1, 0))
    each = plan.near[band][owner[segment]]  # one-deletion neighbourhoods: segments without one of their shingles
    at = segment[each]
    sig = np.concatenate([mix(full ^ salt), mix((full[at] - value[each]) ^ salt[at])])
    who = np.concatenate([owner, owner[at]])
    return sig, sets[who], slack[who]


def class_digests(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, d1, d2) of all rows: the size of the shingle set and a digest of 128 bits."""

    def task(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in steps(offsets):
                h, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                own = np.repeat(np.arange(j - i), sizes)
                d = [grouped_sum(mix(h ^ u64(s)), own, j - i).view(np.int64) for s in (0x1B873593, 0xCC9E2D51 << 20)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(d[0]), pa.array(d[1])], ["doc_id", "n", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n long, d1 long, d2 long")


def signature_rows(docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """(sig, id, size, lower, slack) of all rows of docs."""

    def task(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in steps(offsets):
                h, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                band = plan.band(sizes)
                under = np.where((band > 0) & (plan.num * sizes <= plan.den * plan.ends[np.maximum(band - 1, 0)]), band - 1, -1)
                for where, lower in ((band, False), (under, True)):
                    sig, who, slack = signatures(h, sizes, where, plan, lower)
                    columns = [pa.array(sig.view(np.int64)), pa.array(ids[i:j][who]), pa.array(sizes[who].astype(np.int32)), pa.array(np.full(len(sig), lower)), pa.array(slack.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "id", "size", "lower", "slack"])

    return docs.select("doc_id", "text").mapInArrow(task, "sig long, id long, size int, lower boolean, slack int")


def sketch_bits(size: int) -> int:
    """Bits of a set's sketch: a power of two, at least twice its size."""
    return max(64, 1 << int(2 * size - 1).bit_length())


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by hash: two sets differ in at least as many shingles as their sketches in bits."""
    bits = np.bincount((mix(h ^ u64(0x94D049BB)) & u64(sketch_bits(len(h)) - 1)).astype(np.int64), minlength=sketch_bits(len(h))) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def packed_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, set, sketch): each row's shingle hashes, sorted, as bytes, and their parity sketch."""

    def task(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in steps(offsets):
                h, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                each = [h[a:b] for a, b in zip(ends[:-1], ends[1:])]
                columns = [pa.array([x.tobytes() for x in each], pa.binary()), pa.array([sketch(x).tobytes() for x in each], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *columns], ["id", "set", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(task, "id long, set binary, sketch binary")


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Those of pairs (a, b), a stored table, whose shingle sets link: den * intersection >= num * union, on the sets themselves.

    The set of a row that is in many pairs as a, a bucket's centre say, goes to a task for each PAIRS of them.
    """
    per = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")))
    tasks = F.ceil(F.col("n") / PAIRS)
    dealt = with_values(pairs, per, "a", "n", "b").withColumn("task", F.pmod(F.xxhash64("b"), tasks)).drop("n")
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")).join(per, "a")
    left = left.withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("n")
    both = dealt.join(left, ["a", "task"]).join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    num, den = plan.num, plan.den

    def task(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    out = materialize(both.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long").distinct())
    discard(per)
    return out


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches as rows of words, long ones folded to the shortest one's bits."""
    short = min(len(x) for x in sketches)
    rows = [np.bitwise_xor.reduce(x.reshape(-1, short), axis=0) for x in sketches]
    return np.stack(rows).view(np.uint64)


def near_pairs(ids, sizes, comps, blocks, sketches, plan: Plan, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that their sizes and sketches leave open.

    blocks: of two different blocks only pairs across them, of one block all. forest: as if open pairs were links, only
    so many of them as join the components that they reach, the nearest first; at most a pair a row.
    """
    x = folded(sketches)
    across = blocks.max() != blocks.min()
    comps = comps.copy()
    left, right = [], []
    for i in range(len(ids)):
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        ok = (comps != comps[i]) & (small * plan.den >= large * plan.num)
        ok[: i + 1] = False
        if across:
            ok &= blocks != blocks[i]
        at = np.flatnonzero(ok)
        if len(at):
            differ = np.bitwise_count(x[at] ^ x[i]).sum(axis=1, dtype=np.int64)
            fit = differ <= plan.differences(sizes[at], sizes[i])
            at = at[fit]
            if forest and len(at):
                at = at[np.argsort(differ[fit], kind="stable")]
                at = at[np.unique(comps[at], return_index=True)[1]]
                comps[np.isin(comps, comps[at])] = comps[i]
            left.append(np.full(len(at), ids[i]))
            right.append(ids[at])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def across_components(open_rows: DataFrame, sets: DataFrame, plan: Plan, forest: bool) -> DataFrame:
    """Candidate pairs of rows (sig, id, size, comp, n) that share a bucket of n rows but no component.

    A bucket is cut into blocks of some BLOCK rows by a hash of the id, and each pair of blocks is a group of its
    own, so that no task holds a bucket. Pairs exist inside a group's arrays only, until their sketches pass.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = open_rows.withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(parts, F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = dealt.join(sets.select("id", "sketch"), "id").select("sig", "lo", "hi", "block", "id", "size", "comp", "sketch")
    grouped = dealt.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")

    def pairs_of(t: pa.Table):
        column = lambda c: t.column(c).to_numpy()
        keys = np.stack([column("sig"), column("lo"), column("hi")])
        begin = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        ids, sizes, comps, blocks = column("id"), column("size").astype(np.int64), column("comp"), column("block")
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("sketch")]
        out = [near_pairs(ids[a:b], sizes[a:b], comps[a:b], blocks[a:b], raw[a:b], plan, forest) for a, b in zip(begin, [*begin[1:], len(ids)])]
        a, b = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def task(batches):
        held: list[pa.RecordBatch] = []  # the rows of the last group seen, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            last = [t.column(c)[-1].as_py() for c in ("sig", "lo", "hi")]
            same = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("sig", "lo", "hi"), last)])
            cut = int(np.argmax(same))
            if cut:
                yield pairs_of(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield pairs_of(pa.Table.from_batches(held))

    return grouped.mapInArrow(task, "a long, b long").distinct()


def prefixes(docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """(sig, id, size): the signatures that sets are indexed by, left out where no other set has them.

    Counts come first, combined before they are shuffled; then each set leaves out as many of its signatures as it
    can, those that most sets have. Signatures are ranked by count and value, for all sets alike.
    """
    rows = signature_rows(docs, width, plan)
    counts = materialize(rows.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = with_values(rows, counts, "sig", "n", "id")
    costly = Window.partitionBy("id", "lower").orderBy(F.desc("n"), "sig")
    kept = materialize(shared.withColumn("place", F.row_number().over(costly)).filter("place > slack").select("sig", "id", "size"))
    discard(counts)
    return kept


def links(docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """(id, component) of all classes that a link joins to another; docs has one row a class of equal sets."""
    kept = prefixes(docs, width, plan)
    buckets = kept.groupBy("sig").agg(F.count("*").alias("n"), F.min(F.struct("id", "size")).alias("x"), F.max("id").alias("last"))
    buckets = materialize(buckets.filter("last <> x.id").drop("last"))
    members = materialize(with_values(kept, buckets, "sig", "n", "id"))
    discard(kept)
    in_reach = F.least("size", "x.size") * plan.den >= F.greatest("size", "x.size") * plan.num
    stars = members.filter((F.col("id") != F.col("x.id")) & in_reach).select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()
    stars = materialize(stars)
    ids = materialize(members.select(F.col("id").alias("doc_id")).distinct())
    sets = materialize(packed_sets(by_ids(docs, ids, "left_semi"), width))
    found = verified(stars, sets, plan)
    labels = connected_components(found)
    # first as few pairs as would join what can be joined, then all pairs of rows that these have not joined
    for forest in (True, False):
        named = materialize(members.select("sig", "id", "size").join(labels, "id", "left").select("sig", "id", "size", F.coalesce("component", "id").alias("comp")))
        mixed = named.groupBy("sig").agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"))
        mixed = materialize(mixed.filter("least <> most").select("sig", "n"))
        more = materialize(across_components(with_values(named, mixed, "sig", "n", "id"), sets, plan, forest))
        added = verified(more, sets, plan)
        if added.limit(1).count():
            joined = materialize(found.union(added))
            discard(labels, found)
            found, labels = joined, connected_components(joined)
        discard(named, mixed, more, added)
    discard(buckets, members, stars, ids, sets, found)
    return labels


def components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows of docs (doc_id, text).

    Rows link when den * intersection >= num * union of their sets of width-word shingles; component_id is the
    smallest doc_id that links reach. A null or blank text has the empty set and links with nothing, nor does a
    row without doc_id (its component is null). Rows of one doc_id are taken as one document when they are
    linked on. Equal sets make a class, of which the smallest doc_id alone is compared, so thousands of copies
    cost no pairs. Sets hold 64-bit hashes of shingles. Other columns are left out; an empty table stays empty.
    """
    plan = Plan(num, den)
    rows = materialize(class_digests(docs, width))
    known = rows.filter("n > 0 and doc_id is not null")
    classes = materialize(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    copies = known.join(classes.filter("copies > 1").select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).filter("doc_id <> rep").select("doc_id")
    copies = copies.distinct().join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    single = by_ids(docs.select("doc_id", "text").filter("doc_id is not null"), materialize(copies), "left_anti")
    labels = links(single, width, plan)
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    shared = named.filter("copies > 1 or component <> rep").select(F.struct("n", "d1", "d2").alias("k"), "component")
    out = salted_lookup(rows.withColumn("k", F.struct("n", "d1", "d2")), materialize(shared), "k", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
