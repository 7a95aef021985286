"""Language ID by multilingual mixtures: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, steps, table, text_buffers

#: Trigrams of folded bytes are counted in so many cells; a model has at most this many numbers a language.
CELLS_LOG2 = 15
CELLS = 1 << CELLS_LOG2
SMOOTH = 0.5
ROUNDS, TOLERANCE = 20, 1e-3
#: Each letter is in three trigrams, so log-likelihoods count threefold against the penalty of a language.
PENALTY = 3.0
#: A partition hands on what it has counted once it holds so many languages.
MOST_LANGS = 64

# letters fold to lower case, bytes of other scripts stay, all else is a space
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigram_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams of the folded texts, runs of spaces taken as one, and where each text's begin."""
    folded = _FOLD[data]
    keep = np.ones(len(folded), dtype=bool)
    space = folded == 32
    keep[1:] = ~(space[1:] & space[:-1])
    lens = np.add.reduceat(np.append(keep, False).astype(np.int64), offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)
    lens[np.diff(offsets) == 0] = 0
    folded = folded[keep]
    at = np.concatenate([[0], np.cumsum(lens)])
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros_like(at)
    wide = folded.astype(np.uint32)
    cells = ((wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - CELLS_LOG2)
    return cells.astype(np.int64), at


def own_cells(cells: np.ndarray, at: np.ndarray, i: int) -> np.ndarray:
    return cells[at[i] : max(at[i], at[i + 1] - 2)]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Languages and probabilities (cells x languages) from all rows of docs (text, lang) with both set.

    Partitions add up their own counts; at most CELLS numbers a language reach the driver.
    """

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def out():
            for lang, c in held.items():
                f = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(f.astype(np.int32)), pa.array(c[f])], ["lang", "cell", "n"])

        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for i, j in steps(offsets):
                cells, at = trigram_cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                parts: dict[str, list] = {}
                for k in range(i, j):
                    parts.setdefault(langs[k], []).append(own_cells(cells, at, k - i))
                for lang, xs in parts.items():
                    c = np.bincount(np.concatenate(xs), minlength=CELLS)
                    held[lang] = held[lang] + c if lang in held else c
            if len(held) > MOST_LANGS:
                yield from out()
                held = {}
        yield from out()

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = known.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    langs = sorted(counts["lang"].unique())
    matrix = np.zeros((CELLS, len(langs)))
    matrix[counts["cell"].to_numpy(), np.searchsorted(langs, counts["lang"].to_numpy().astype(str))] = counts["n"].to_numpy()
    return langs, (matrix + SMOOTH) / (matrix.sum(axis=0) + SMOOTH * CELLS)


def fit(p: np.ndarray, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the mixture of p's columns that makes counts x likeliest, and that log-likelihood."""
    n, w = x.sum(), start
    for _ in range(ROUNDS):
        at = p @ w
        new = w * ((x / at) @ p) / n
        done = np.abs(new - w).max() < TOLERANCE
        w = new
        if done:
            break
    return w, float(x @ np.log(p @ w))


def infer(p: np.ndarray, logs: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Proportions of all languages in a text and the set of languages of best penalised likelihood.

    Sets are the 1, 2, ... largest shares of the full fit; each language costs half the log of the text's
    trigrams, threefold as trigrams overlap. Larger sets are tried while they gain.
    """
    langs = p.shape[1]
    shares, _ = fit(p, x, np.full(langs, 1 / langs))
    order = np.argsort(-shares, kind="stable")
    cost = PENALTY * 0.5 * math.log(max(2.0, float(x.sum())))
    single = x @ logs
    best = int(np.argmax(single))
    chosen, top = [best], float(single[best]) - cost
    for k in range(2, langs + 1):
        own = order[:k]
        if shares[own[-1]] < 0.01:
            break
        _, ll = fit(p[:, own], x, shares[own] / shares[own].sum())
        if ll - cost * k <= top:
            break
        chosen, top = [int(i) for i in own], ll - cost * k
    return shares, chosen


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """docs with lang_pred, score and langs: the text's dominant language, its share, and its language set.

    The columns of docs stay, repeated rows too, but columns of those three names are replaced. lang_pred is
    `und` with score 0 and an empty set where text is null or has no letter, or nothing was learned. Texts too short for a trigram
    take the likeliest language of what the fold leaves; ties go to the language first by code point.
    """
    spark = docs.sparkSession
    base = docs.drop("lang_pred", "score", "langs")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    names = base.columns
    shared = spark.sparkContext.broadcast(model)

    def task(batches):
        known = shared.value
        if known is not None:
            langs, p = known
            logs = np.log(p)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            pred, score, sets = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for i, j in steps(offsets) if known is not None else ():
                part = data[offsets[i] : offsets[j]]
                cells, at = trigram_cells(part, offsets[i : j + 1] - offsets[i])
                letters = np.concatenate([[0], np.cumsum(((part | 32) >= 97) & ((part | 32) <= 122))])
                for k in range(i, j):
                    a, b = offsets[k] - offsets[i], offsets[k + 1] - offsets[i]
                    if letters[a] == letters[b] and not has_letter(part[a:b].tobytes().decode("utf-8", "replace")):
                        continue
                    own = own_cells(cells, at, k - i)
                    if not len(own):
                        folded = np.concatenate([[32], _FOLD[part[a:b]], [32, 32]]).astype(np.uint8)
                        own, _ = trigram_cells(folded, np.array([0, len(folded)]))
                        own = own if len(own) else np.zeros(1, np.int64)
                    x = np.bincount(own, minlength=CELLS)
                    f = np.flatnonzero(x != 0)
                    shares, chosen = infer(p[f], logs[f], x[f].astype(float))
                    top = max(chosen, key=lambda c: shares[c])
                    pred[k], score[k], sets[k] = langs[top], float(min(1.0, shares[top])), [langs[c] for c in chosen]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], [*names, "lang_pred", "score", "langs"])

    return base.mapInArrow(task, f"{fields}, lang_pred string, score double, langs array<string>")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 5) == 0
    model = learn(docs.filter(~held))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs")
