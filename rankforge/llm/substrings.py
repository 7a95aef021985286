"""Passages that repeat, within a document or across documents, by suffix trees in prefix partitions.

1. Every window of WIDTH words has an anchor, its GRAM words of the smallest hash; equal windows have equal anchors, at
   one offset. Windows whose anchor occurs once repeat nowhere; of the others come the suffixes.
2. Suffixes fall into groups by a prefix of 1, 2, 4, ... words: the shortest whose share of a histogram fits in
   GROUP suffixes. What all WIDTH words leave too large are copies of one window, which every task sends once.
3. A group's suffixes are sorted, which with the lengths of common prefixes is their suffix tree, cut at WIDTH words,
   as deeper branches change no window. Its nodes of that depth are the repeats; all their leaves but the first go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, _SEP, discard, materialize, mix, powers, steps, table, text_buffers, with_values, word_hashes

#: Words of a window, and of the anchor that each window has.
WIDTH, GRAM = 20, 6
#: Suffixes that a group may have before a longer prefix splits it, and the counters of the histogram of each prefix length.
GROUP, COUNTERS = 1 << 15, 4096
#: Suffixes that a task holds before it sends them on.
HELD = 1 << 19
#: The last number there is stands for a null id, which comes after all others.
LAST = (1 << 63) - 1


def sums_of(words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(len(words))[0][: len(words)], dtype=np.uint64)])


def rolling(sums: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the k words from each of the places at (all that there are), from the running sums of sums_of."""
    n = max(0, len(sums) - k)
    down = powers(len(sums))[1]
    return mix((sums[k:] - sums[:n]) * down[:n] if at is None else (sums[at + k] - sums[at]) * down[at])


def windows(counts: np.ndarray, width: int) -> np.ndarray:
    """Places of all words with width - 1 words of their text after them."""
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(int(counts.sum()))
    return np.flatnonzero(left >= width)


def anchors_of(words: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all grams and, of each window, the place of its anchor: its gram of the smallest hash, the first of equal ones."""
    hashes, place = rolling(sums_of(words), gram), at.copy()
    for i in range(0, len(at), HELD):
        place[i : i + HELD] += sliding_window_view(hashes, width - gram + 1)[at[i : i + HELD]].argmin(axis=1)
    return hashes, place


def keyed(docs: DataFrame) -> DataFrame:
    """docs with oid, the id by which documents are ordered, and th, which orders different texts of one id."""
    return docs.withColumn("oid", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


def words_of(batch: pa.RecordBatch):
    """(first row, end row, word hashes, words of each row) for steps of a batch's texts."""
    data, offsets = text_buffers(batch.column("text"))
    for i, j in steps(offsets):
        yield (i, j, *word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _SEP, _BYTE))


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """(h, oid, th, place) of all anchors."""

    def task(batches):
        for batch in batches:
            oid, th = batch.column("oid"), batch.column("th")
            for i, _, words, counts in words_of(batch):
                hashes, place = anchors_of(words, windows(counts, width), width, min(GRAM, width))
                place = np.unique(place)
                begins = np.cumsum(counts) - counts
                own = np.repeat(np.arange(len(counts)), counts)[place]
                rows = pa.array(own + i)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[place].view(np.int64)), oid.take(rows), th.take(rows), pa.array((place - begins[own]).astype(np.int32))], ["h", "oid", "th", "place"])

    return docs.select("oid", "th", "text").mapInArrow(task, "h long, oid long, th long, place int")


def stretches(docs: DataFrame, width: int) -> DataFrame:
    """(oid, th, start, words) of the words of consecutive windows whose anchors repeat; docs has the places of those in places."""

    def task(batches):
        for batch in batches:
            oid, th = batch.column("oid"), batch.column("th")
            for i, j, words, counts in words_of(batch):
                begins = np.cumsum(counts) - counts
                repeated = np.zeros(len(words) + 1, bool)
                for d in range(i, j):
                    repeated[begins[d - i] + batch.column("places")[d].values.to_numpy(zero_copy_only=False)] = True
                at = windows(counts, width)
                at = at[repeated[anchors_of(words, at, width, min(GRAM, width))[1]]]
                own = np.repeat(np.arange(len(counts)), counts)[at]
                cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])])) if len(at) else at
                last = np.concatenate([cut[1:], [len(at)]])[: len(cut)] - 1
                rows = pa.array(own[cut] + i)
                parts = pa.array([words[a : b + width].tobytes() for a, b in zip(at[cut], at[last])], pa.binary())
                yield pa.RecordBatch.from_arrays([oid.take(rows), th.take(rows), pa.array((at[cut] - begins[own[cut]]).astype(np.int32)), parts], ["oid", "th", "start", "words"])

    return docs.select("oid", "th", "text", "places").mapInArrow(task, "oid long, th long, start int, words binary")


def prefix_lengths(width: int) -> list[int]:
    out = [1]
    while 2 * out[-1] < width:
        out.append(2 * out[-1])
    return [*out, width] if width > 1 else out


def held(batch: pa.RecordBatch):
    """(row of each suffix, its place in words, words, first word of each row) for the stretches of a batch, about HELD words at a time."""
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("words")).to_numpy())])
    for i, j in steps(offsets, 8 * HELD):
        words = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("words")[i:j]), np.uint64)
        counts = np.diff(offsets[i : j + 1]) // 8
        yield np.repeat(np.arange(i, j), counts), words, np.cumsum(counts) - counts, counts, i


def histogram(parts: DataFrame, width: int) -> np.ndarray:
    """How many suffixes each counter of each prefix length has; COUNTERS of them a length, whatever the corpus."""
    lengths = prefix_lengths(width)

    def task(batches):
        total = np.zeros((len(lengths), COUNTERS), np.int64)
        for batch in batches:
            for _, words, _, counts, _ in held(batch):
                at, sums = windows(counts, width), sums_of(words)
                for k, length in enumerate(lengths):
                    total[k] += np.bincount((rolling(sums, length, at) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["counter", "n"])

    got = parts.select("words").mapInArrow(task, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(lengths) * COUNTERS, np.int64)
    out[got["counter"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(len(lengths), COUNTERS)


#: Where a suffix stands.
PLACE = np.dtype([("oid", "i8"), ("th", "i8"), ("place", "i4")])


def record(width: int) -> np.dtype:
    """A suffix: a byte of each of its words and the hash of all, and where it stands."""
    return np.dtype([("key", f"V{width + 8}"), *[(c, PLACE[c]) for c in PLACE.names]])


def packed(rows: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    """(group, packed): the rows of each group as one binary."""
    order = np.argsort(groups, kind="stable")
    rows, groups = rows[order], groups[order]
    cut = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    offsets = pa.array(np.concatenate([cut, [len(rows)]]) * rows.dtype.itemsize, pa.int32()).buffers()[1]
    binary = pa.Array.from_buffers(pa.binary(), len(cut), [None, offsets, pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(groups[cut].astype(np.int64)), binary], ["group", "packed"])


def places_of(rows: np.ndarray, shares: int) -> pa.RecordBatch:
    """The places of rows, dealt over shares by document; these groups are below 0."""
    own = np.empty(len(rows), PLACE)
    for c in PLACE.names:
        own[c] = rows[c]
    return packed(own, -1 - (mix(own["oid"].view(np.uint64) ^ mix(own["th"].view(np.uint64))) % np.uint64(shares)).astype(np.int64))


def suffixes(parts: DataFrame, sizes: np.ndarray, width: int, shares: int) -> DataFrame:
    """(group, packed) of the suffixes, and of the places of those that repeat one of the same task.

    A task sends only the first suffix of each window that it holds, so that a passage of many documents is a record a task.
    """
    lengths, kind = prefix_lengths(width), record(width)
    full = sizes > GROUP
    most = 1 + int(sizes[-2][full[-2]].sum() if len(lengths) > 1 else sizes[-1].sum()) // GROUP

    def group_of(sums: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        out = (whole % np.uint64(most)).astype(np.int64) + (len(lengths) - 1) * COUNTERS
        for k in range(len(lengths) - 2, -1, -1):
            counter = (rolling(sums, lengths[k], at) % np.uint64(COUNTERS)).astype(np.int64)
            out = np.where(full[k][counter], out, counter + k * COUNTERS)
        return out

    def sent(some: list[tuple]):
        rows, groups, window = (np.concatenate(c) for c in zip(*some))
        order = np.lexsort((rows["place"], rows["th"], rows["oid"], window))
        rows, groups, window = rows[order], groups[order], window[order]
        again = np.concatenate([[False], window[1:] == window[:-1]])
        later = rows[again & differs(rows, again)]
        if len(later):
            yield places_of(later, shares)
        yield packed(rows[~again], groups[~again])

    def task(batches):
        some, n = [], 0
        for batch in batches:
            oid, th, start = (batch.column(c).to_numpy() for c in ("oid", "th", "start"))
            for own, words, begins, counts, i in held(batch):
                at, sums = windows(counts, width), sums_of(words)
                own, whole = own[at], rolling(sums, width, at)
                rows, key = np.empty(len(at), kind), np.empty((len(at), width + 8), np.uint8)
                key[:, :width] = sliding_window_view((words >> np.uint64(56)).astype(np.uint8), width)[at]
                key[:, width:] = whole.view(np.uint8).reshape(-1, 8)
                rows["key"] = key.view(kind["key"]).ravel()
                rows["oid"], rows["th"], rows["place"] = oid[own], th[own], start[own] + at - begins[own - i]
                some.append((rows, group_of(sums, at, whole), whole))
                n += len(at)
                if n >= HELD:
                    yield from sent(some)
                    some, n = [], 0
        if n:
            yield from sent(some)

    return parts.mapInArrow(task, "group long, packed binary")


def columns_of(key: np.ndarray) -> list[np.ndarray]:
    """Sort columns of the keys: the hash of all words, then parts of the words, of which the last is the first to sort by."""
    each = np.ascontiguousarray(key).view(np.uint8).reshape(len(key), -1)
    width = each.shape[1] - 8
    padded = np.zeros((len(key), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = each[:, :width]
    return [each[:, width:].copy().view(np.uint64).ravel(), *padded.view(">u8").astype(np.uint64).T[::-1]]


def differs(rows: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Whether a row stands elsewhere than the first of its window; rows of one id and text are one document."""
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(rows))))
    return (rows["oid"] != rows["oid"][first]) | (rows["th"] != rows["th"][first]) | (rows["place"] != rows["place"][first])


def by_text(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(oid, th, places) of the documents that places are of."""
    rows = rows[np.lexsort((rows["place"], rows["th"], rows["oid"]))]
    cut = np.flatnonzero(np.concatenate([[True], (rows["oid"][1:] != rows["oid"][:-1]) | (rows["th"][1:] != rows["th"][:-1])]))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([cut, [len(rows)]]).astype(np.int32)), pa.array(rows["place"].astype(np.int32)))
    return rows["oid"][cut].astype(np.int64), rows["th"][cut].astype(np.int64), lists


class Tree:
    """The suffix tree of a group, cut at width words: its leaves in order and the words that neighbours share."""

    def __init__(self, rows: np.ndarray, width: int):
        order = np.lexsort((rows["place"], rows["th"], rows["oid"], *columns_of(rows["key"])))
        self.leaves, self.width = rows[order], width
        each = np.ascontiguousarray(self.leaves["key"]).view(np.uint8).reshape(len(rows), -1)
        unlike = np.concatenate([each[1:, :width] != each[:-1, :width], np.ones((max(0, len(rows) - 1), 1), bool)], axis=1)
        self.shared = unlike.argmax(axis=1)
        whole = (each[1:, width:] == each[:-1, width:]).all(axis=1)
        self.shared[(self.shared == width) & ~whole] = width - 1  # words that only look alike in a byte

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first leaf, end) of the internal nodes that have so many words or more, the topmost of each branch."""
        deep = np.concatenate([[False], self.shared >= depth, [False]])
        return np.flatnonzero(~deep[:-1] & deep[1:]), np.flatnonzero(deep[:-1] & ~deep[1:]) + 1

    def later(self) -> np.ndarray:
        """The leaves of the deepest nodes that stand elsewhere than their node's first."""
        edge = np.zeros(len(self.leaves) + 2, np.int64)
        first, end = self.nodes(self.width)
        edge[first + 1] += 1
        edge[end] -= 1
        again = np.cumsum(edge)[: len(self.leaves)] > 0
        return self.leaves[again & differs(self.leaves, again)]


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(oid, th, places): where windows of width words start whose words also start at an earlier place, a row for each document with such.

    Places are ordered by id (null last), by hash of the text for different texts of one id, then by word number.
    """
    found = materialize(anchors(docs, width))
    counts = materialize(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    again = with_values(found, counts, "h", "n", "place").groupBy("oid", "th").agg(F.collect_set("place").alias("places"))
    parts = materialize(stretches(docs.join(again, ["oid", "th"]), width))
    discard(found, counts)
    sizes = histogram(parts, width)
    shares = 1 + int(sizes[-1].sum()) // HELD
    kind = record(width)

    def runs(batches):
        """(group, parts of it) of sorted rows."""
        group, some = None, []
        for batch in batches:
            for g, x in zip(batch.column("group").to_pylist(), batch.column("packed")):
                if g != group and some:
                    yield group, some
                    some = []
                group = g
                some.append(np.frombuffer(x.as_buffer(), PLACE if g < 0 else kind))
        if some:
            yield group, some

    def trees(batches):
        later, n = [], 0
        for group, some in runs(batches):
            if group < 0:
                later += some
                n += sum(map(len, some))
            else:
                later.append(Tree(np.concatenate(some), width).later()[list(PLACE.names)].astype(PLACE))
                n += len(later[-1])
            if n >= HELD:
                yield places_of(np.concatenate(later), shares)
                later, n = [], 0
        if n:
            yield places_of(np.concatenate(later), shares)

    def texts(batches):
        for _, some in runs(batches):
            oid, th, lists = by_text(np.concatenate(some))
            yield pa.RecordBatch.from_arrays([pa.array(oid), pa.array(th), lists], ["oid", "th", "places"])

    grouped = lambda df: df.repartition("group").sortWithinPartitions("group")
    near = materialize(grouped(suffixes(parts, sizes, width, shares)).mapInArrow(trees, "group long, packed binary"))
    discard(parts)
    return grouped(near).mapInArrow(texts, "oid long, th long, places array<int>")


def drop_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), a row for each row of docs.

    Every word goes that is in a window of width consecutive words whose words also start earlier, in a document of
    smaller id or earlier in this one; windows are judged on the input. kept has the other words joined by a space.
    Words are the runs of bytes other than space, tab to carriage return, unchanged. Null and empty texts have none,
    and texts of fewer words than width lose none. A null id comes after all others; rows of one id and text are one
    document, and different texts of one id are ordered by hash. Other columns are left out.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    later = repeats(rows, width)

    def left(text: str | None, places) -> tuple[int, int, bytes]:
        words = (text or "").encode().split()
        keep = np.ones(len(words), bool)
        if places is not None:
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(places.to_numpy(zero_copy_only=False))
            edge[at] += 1
            edge[at + width] -= 1
            keep = np.cumsum(edge[:-1]) == 0
        kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
        return len(words), len(words) - len(kept), b" ".join(kept)

    def task(batches):
        for batch in batches:
            texts, places = batch.column("text"), batch.column("places")
            for i, j in steps(text_buffers(texts)[1]):
                n, gone, kept = zip(*[left(texts[d].as_py(), places[d].values) for d in range(i, j)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    whole = rows.join(later, ["oid", "th"], "left").select("doc_id", "text", "places")
    return whole.mapInArrow(task, "doc_id long, n_words long, n_removed long, kept string")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
