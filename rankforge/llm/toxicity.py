"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import pickle
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_LETTER, remainder, shared_dir, steps, table, text_buffers, word_hashes
from .warc import open_file

#: Labelled rows of each class that are drawn, by keyed hash of the id, to fit the index and its calibration.
TOXIC_ROWS, CLEAN_ROWS = 1600, 3000
#: Of these, examples of each class in the index; where rows are few, half of a class.
INDEX_ROWS = 768
#: Examples in a block of the index.
BLOCK = 64
#: Terms in more examples than this have dense rows and block maxima; the postings of rarer ones are short.
HEAD = 40
#: Nearest examples that vote, the similarity that the prior has in the vote, and examples shown as evidence.
NEAREST, PRIOR_VOTE, SHOWN = 15, 0.05, 3
#: A term whose class frequencies differ (chi-squared above CHI) weighs more, by GAIN times its phi coefficient. Of the
#: pairs tried (GAIN 25 and 50 with CHI 6.63, 10.83, 15, 25, 40, and GAIN 0, 10, 35, 100 with CHI 15) this one had the
#: least log loss over three folds of learnable labels.
CHI, GAIN = 25.0, 50.0
#: Leading bits of a term's hash that name its file of document frequencies, and terms a task counts before it passes them on.
FILE_BITS, COUNTED = 6, 500_000


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter runs of some texts and the text that each is in."""
    h, counts = word_hashes(data, offsets, NOT_LETTER)
    return h, np.repeat(np.arange(len(counts)), counts)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in own terms, count) of all terms of some texts, ordered by text and term, and the sorted terms."""
    h, doc = terms(data, offsets)
    own, at = np.unique(h, return_inverse=True)
    key, n = np.unique(doc * len(own) + at, return_counts=True)
    most = max(1, len(own))
    return key // most, key % most, n, own


def drawn(labels: DataFrame, docs: DataFrame) -> tuple[pa.Table | None, float]:
    """The bounded sample of labelled rows (doc_id, text, toxic), and the share of toxic rows in all labels.

    A doc_id with labels of both kinds is toxic, and of several texts under one id the least is taken. The rows of a class with the least keyed hashes are taken; at most TOXIC_ROWS + CLEAN_ROWS texts are fetched.
    """
    rows = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64(F.lit(5), "doc_id"))
    share = rows.agg(F.avg("toxic")).first()[0]
    if share is None:
        return None, 0.0
    pick = lambda toxic, n: rows.filter(F.col("toxic") == toxic).orderBy("_h", "doc_id").limit(n).select("doc_id", "toxic")
    ids = pick(1, TOXIC_ROWS).union(pick(0, CLEAN_ROWS))
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter("text is not null")
    got = got.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")
    return got.toArrow().sort_by("doc_id"), float(share)


class Frequencies:
    """In how many rows of a table each term occurs, over all its terms, from sorted files in the shared folder.

    Files are mapped, not read, where the folder is mounted, so memory does not grow with the vocabulary.
    """

    def __init__(self, paths: dict[int, str], total: int):
        self.paths, self.total, self.open = paths, total, {}

    def __getstate__(self):
        return {"paths": self.paths, "total": self.total, "open": {}}

    def file(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if number not in self.open:
            self.open[number] = tuple(mapped(f"{self.paths[number]}.{kind}") for kind in ("terms", "counts"))
        return self.open[number]

    def idf(self, own: np.ndarray) -> np.ndarray:
        """Inverse document frequencies of some sorted terms."""
        df = np.zeros(len(own), np.int64)
        ends = np.searchsorted(own >> np.uint64(64 - FILE_BITS), np.arange((1 << FILE_BITS) + 1, dtype=np.uint64))
        for number in self.paths:
            part = own[ends[number] : ends[number + 1]]
            if len(part):
                known, counts = self.file(number)
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                df[ends[number] : ends[number + 1]] = np.where(known[at] == part, counts[at].astype(np.int64), 0)
        return np.log((self.total + 1) / (np.minimum(df, self.total) + 1))


def mapped(path: str) -> np.ndarray:
    if re.match(r"file:|/", path):
        return np.memmap(re.sub(r"^file:/*", "/", path), "<u8", "r")
    with open_file(path, "rb") as f:
        return np.frombuffer(f.read(), "<u8")


def document_frequency(docs: DataFrame) -> Frequencies:
    """Counts the rows of docs that each term occurs in, by shuffle."""
    folder = f"{shared_dir(docs.sparkSession)}/terms-{uuid.uuid4().hex}"

    def merged(parts):
        own, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        return own, np.bincount(at, np.concatenate([n for _, n in parts]), len(own)).astype(np.int64)

    def rows(own, n, kind):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.view(np.int64)), pa.array(n)], ["file", "term", "n"])

    def count(batches):
        parts, size, total = [], 0, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            total += batch.num_rows
            for i, j in steps(offsets):
                _, t, _, own = term_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts.append((own, np.bincount(t, minlength=len(own))))
                size += len(own)
                if size > COUNTED:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > COUNTED // 2:
                        yield rows(*parts[0], 0)
                        parts, size = [], 0
        if parts:
            yield rows(*merged(parts), 0)
        yield rows(np.zeros(1, np.uint64), np.array([total]), -1)  # the number of rows

    def write(batches):
        made, out, name = {}, (), None
        for batch in batches:
            number = batch.column("file").to_numpy()
            for k in np.unique(number).tolist():
                part = batch.filter(pa.array(number == k))
                if k < 0:
                    made[k] = str(part.column("n")[0].as_py())
                    continue
                if name != k:
                    for f in out:
                        f.close()
                    name, made[k] = k, f"{folder}/{k}-{uuid.uuid4().hex}"
                    out = [open_file(f"{made[k]}.{kind}", "wb") for kind in ("terms", "counts")]
                for f, column in zip(out, ("term", "n")):
                    f.write(part.column(column).to_numpy().astype("<i8").tobytes())
        for f in out:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array(list(made.values()), pa.string())], ["file", "path"])

    found = docs.select("text").mapInArrow(count, "file int, term long, n long")
    found = found.withColumn("file", F.when(F.col("file") < 0, -1).otherwise(F.shiftrightunsigned("term", 64 - FILE_BITS)).cast("int"))
    found = found.groupBy("file", "term").agg(F.sum("n").alias("n")).repartition(1 << FILE_BITS, "file").sortWithinPartitions("file", "term")
    paths = {r["file"]: r["path"] for r in found.mapInArrow(write, "file int, path string").collect()}
    return Frequencies(paths, int(paths.pop(-1, 0)))


class Index:
    """Examples in blocks: postings of rare terms, dense rows and per-block maxima of the others."""

    def __init__(self, rows, vocab, weight, labels, ids):
        """rows: (example, term, count) sorted by example; examples are laid out by label, then by their main term."""
        self.vocab, self.weight = vocab, weight
        doc, term, n = rows
        value = (1 + np.log(n)) * weight[term]
        norm = np.sqrt(np.bincount(doc, value**2, minlength=len(labels)))
        value = value / np.where(norm > 0, norm, 1)[doc]
        main = np.zeros(len(labels), np.int64)
        order = np.argsort(value, kind="stable")
        main[doc[order]] = term[order]
        place = np.empty(len(labels), np.int64)
        place[np.lexsort((main, labels))] = np.arange(len(labels))
        self.size = -(-len(labels) // BLOCK) * BLOCK
        self.labels, self.ids = np.zeros(self.size), np.full(self.size, -1, np.int64)
        self.labels[place], self.ids[place] = labels, ids
        self.real = len(labels)
        doc = place[doc]
        df = np.bincount(term, minlength=len(vocab))
        self.head = np.full(len(vocab), -1, np.int64)
        common = np.flatnonzero(df > HEAD)
        self.head[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.size), np.float32)
        is_head = self.head[term] >= 0
        self.dense[self.head[term[is_head]], doc[is_head]] = value[is_head]
        self.blocks = np.ascontiguousarray(self.dense.reshape(len(common), self.size // BLOCK, BLOCK).transpose(1, 0, 2))
        self.most = self.dense.reshape(len(common), self.size // BLOCK, BLOCK).max(axis=2)
        order = np.argsort(term[~is_head], kind="stable")
        self.post_doc, self.post_value = doc[~is_head][order], value[~is_head][order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term[~is_head], minlength=len(vocab)))])

    def nearest(self, term: np.ndarray, n: np.ndarray, outside: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the NEAREST examples of positive similarity, nearest first.

        outside: the sum of squared weights of the text's terms that no sampled row has; they belong to its norm.

        Rare terms are summed exactly. A block's bound is its best such sum plus the query's weights times the
        block's maxima of common terms. The two blocks of the highest bounds are scored first; of the others only
        those whose bound reaches the NEAREST-th score, so no nearer example is missed.
        """
        q = (1 + np.log(n)) * self.weight[term]
        norm = np.sqrt((q**2).sum() + outside)
        if not norm or not len(q):
            return np.zeros(0, np.int64), np.zeros(0)
        q = q / norm
        head = self.head[term]
        common, rare = head >= 0, head < 0
        begin, count = self.start[term[rare]], self.start[term[rare] + 1] - self.start[term[rare]]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        score = np.bincount(self.post_doc[at], self.post_value[at] * np.repeat(q[rare], count), minlength=self.size)
        rows, w = head[common], q[common].astype(np.float32)
        bound = score.reshape(-1, BLOCK).max(axis=1) + w @ self.most[rows]
        order = np.argsort(-bound, kind="stable")
        parts = [self.scored(order[:2], rows, w, score)]
        least = np.partition(parts[0][1], -NEAREST)[-NEAREST]
        if (bound[order[2:]] >= least - 1e-5).any():
            parts.append(self.scored(order[2:][bound[order[2:]] >= least - 1e-5], rows, w, score))
        cols, exact = (np.concatenate(x) for x in zip(*parts))
        keep = exact > 1e-9
        cols, exact = cols[keep], exact[keep]
        best = np.lexsort((self.ids[cols], -exact))[:NEAREST]
        return cols[best], exact[best]

    def scored(self, blocks: np.ndarray, rows: np.ndarray, w: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of some blocks and their cosines."""
        cols = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        if len(blocks) * 4 > len(self.blocks):  # whole rows are read faster than many short pieces
            return cols, rare[cols] + (w @ self.dense[rows])[cols]
        return cols, rare[cols] + np.concatenate([w @ self.blocks[b][rows] for b in blocks])

    def vote(self, places: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        return float((cosines @ self.labels[places] + PRIOR_VOTE * prior) / (cosines.sum() + PRIOR_VOTE))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing curve through (x, y) of least weighted squares, one a level."""
    levels: list[list[float]] = []  # [mean, weight, sum of w * x]
    for i in np.argsort(x, kind="stable"):
        levels.append([float(y[i]), float(w[i]), float(w[i] * x[i])])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            b, a = levels.pop(), levels.pop()
            levels.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.array([s / n for _, n, s in levels]), np.array([m for m, *_ in levels])


def fit(labels: DataFrame, docs: DataFrame) -> dict:
    """The index, the prior and the calibration curve. The index holds all terms of the sampled rows.

    labels (doc_id, toxic) are all rows that may be learned from; docs (doc_id, text) are all documents, whose
    document frequencies give the inverse ones. Without examples of both classes the model is the prior alone.
    """
    rows, share = drawn(labels, docs)
    if rows is None:
        return {"prior": share, "index": None}
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return {"prior": share, "index": None}
    data, offsets = text_buffers(rows["text"])
    parts = [(i, *terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in steps(offsets)]
    h, doc = np.concatenate([h for _, h, _ in parts]), np.concatenate([i + d for i, _, d in parts])
    ids = rows["doc_id"].to_numpy()
    del rows, data, offsets, parts
    vocab, at = np.unique(h, return_inverse=True)
    key, n = np.unique(doc * len(vocab) + at, return_counts=True)
    doc, term = key // len(vocab), key % len(vocab)
    del h, at, key
    rank = np.empty(len(ids), np.int64)
    for c in (0, 1):
        own = np.flatnonzero(toxic == c)
        rank[own] = np.random.default_rng(3).permutation(len(own))
    size = {c: min(INDEX_ROWS, int((toxic == c).sum() + 1) // 2) for c in (0, 1)}
    inside = rank < np.where(toxic == 1, size[1], size[0])
    frequencies = document_frequency(docs)
    idf = frequencies.idf(vocab)
    seen = [np.bincount(term[toxic[doc] == c], minlength=len(vocab)) for c in (0, 1)]
    p = toxic.mean()
    both = seen[0] + seen[1]
    chi = (seen[1] - both * p) ** 2 / (both * p * (1 - p))
    weight = idf * (1 + GAIN * np.where(chi > CHI, np.sqrt(chi / len(toxic)), 0))
    own = inside[doc]
    number = np.cumsum(inside) - 1
    index = Index((number[doc[own]], term[own], n[own]), vocab, weight, toxic[inside], ids[inside])
    begin = np.searchsorted(doc, np.arange(len(toxic) + 1))
    rest = np.flatnonzero(~inside)
    votes = np.array([index.vote(*index.nearest(term[begin[i] : begin[i + 1]], n[begin[i] : begin[i + 1]]), share) for i in rest])
    if not 0 < toxic[rest].sum() < len(rest):
        return {"prior": share, "index": index, "frequencies": frequencies, "curve": (np.array([0.0, 1.0]), np.array([0.0, 1.0]))}
    per = np.where(toxic[rest] == 1, share / toxic[rest].sum(), (1 - share) / (1 - toxic[rest]).sum())
    return {"prior": share, "index": index, "frequencies": frequencies, "curve": isotonic(votes, toxic[rest].astype(float), per)}


def queries(data: np.ndarray, offsets: np.ndarray, index: Index, frequencies: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, count) of the index's terms in some texts, and each text's sum of squared weights of other terms."""
    doc, at, n, own = term_counts(data, offsets)
    place = np.minimum(np.searchsorted(index.vocab, own), len(index.vocab) - 1)
    known = index.vocab[place] == own if len(index.vocab) else np.zeros(len(own), bool)
    square = np.zeros(len(own))
    square[~known] = frequencies.idf(own[~known]) ** 2
    outside = np.bincount(doc, (1 + np.log(n)) ** 2 * square[at], len(offsets) - 1)
    inside = known[at]
    return doc[inside], place[at[inside]], n[inside], outside


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted, evidence) of all rows of docs (doc_id, text).

    A null or empty text, or one without a known term, has the prior's vote and no evidence. Evidence are the
    SHOWN nearest examples: (doc_id, cosine, toxic). Rows stay as they are, repeated ones too; other columns are
    left out; equal texts get equal scores; ties in nearness go to the smaller id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def task(batches):
        m = pickle.loads(shared.value)
        index, prior = m["index"], m["prior"]
        for batch in batches:
            out, shown = np.full(batch.num_rows, prior), [[]] * batch.num_rows
            if index is not None:
                data, offsets = text_buffers(batch.column("text"))
                for i, j in steps(offsets):
                    doc, term, n, outside = queries(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], index, m["frequencies"])
                    begin = np.searchsorted(doc, np.arange(j - i + 1))
                    for k in range(j - i):
                        places, cosines = index.nearest(term[begin[k] : begin[k + 1]], n[begin[k] : begin[k + 1]], outside[k])
                        v = index.vote(places, cosines, prior)
                        out[i + k] = min(1.0, max(0.0, 0.998 * np.interp(v, *m["curve"]) + 0.002 * v))
                        shown[i + k] = [{"doc_id": int(index.ids[p]), "cosine": float(c), "toxic": int(index.labels[p])} for p, c in zip(places[:SHOWN], cosines[:SHOWN])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array((out >= 0.3).astype(np.int32)), pa.array(shown, evidence)], ["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(labels.filter(remainder("doc_id", 4) != 2).select("doc_id", "toxic"), docs)
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
