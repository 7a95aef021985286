"""LM scoring: a Katz trigram model with Good-Turing discounts and exactly normalised backoff weights.

Texts are cut into chunks of some megabytes whose words are coded once. A chunk asks for what it needs of the
model in rounds: counts of its words, pairs and triples, backoff weights of its words and then of its pairs as
contexts. Each round deals the chunk's distinct keys to buckets by hash, where all chunks' training counts of a key
meet, and brings the sums back. Every table is partitioned by bucket or chunk, so the work of a task does not grow
with the data. An unseen triple has the weight of its pair times the probability of its last pair, which is
worked out in the same way from words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, mix, remainder, steps, table, text_buffers, word_hashes

#: Counts up to this are discounted by Good and Turing; higher ones lose as much in all as this one does.
K = 5
#: Bytes of text in a chunk, and entries that a bucket gets in a round.
CHUNK_BYTES, BUCKET_ENTRIES = 8 << 20, 400_000
END = np.uint64(0xE4D0FD0C0DE5EED1)
_COUNTED = ", ".join(f"n{r} long" for r in range(1, K + 2))


def discounts(n: list[int]) -> list[float]:
    """What is kept of counts 1 to K (index 0 is unused), from the numbers n[r] of types that occur r times.

    Good-Turing by Katz's formula; where the counts of counts are too few for it, absolute discounting. All lie
    strictly between 0 and 1.
    """
    kept = [0.0]
    if all(n[r] > 0 for r in range(1, K + 2)) and (common := (K + 1) * n[K + 1] / n[1]) < 1:
        kept += [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, K + 1)]
    if len(kept) == 1 or not all(0 < d < 1 for d in kept[1:]):
        d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        kept = [0.0] + [1 - d / r for r in range(1, K + 1)]
    return kept


def discounted(c: np.ndarray, kept: list[float]) -> np.ndarray:
    """Counts after discounting; beyond K all lose what K loses, so that each context leaves mass for backoff."""
    low = np.array(kept)[np.minimum(c, K)] * np.minimum(c, K)
    return np.where(c <= K, low, c - K * (1 - kept[K]))


def coded(docs: DataFrame) -> DataFrame:
    """A row a chunk: its documents, their token counts, its distinct token hashes in order, and its tokens by number.

    docs has doc_id, text and held. counts are the training counts of the chunk's distinct tokens.
    """

    def task(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for i, j in steps(offsets, CHUNK_BYTES):
                parts, sizes = [], []
                for a, b in steps(offsets[i : j + 1]):
                    h, n = word_hashes(data[offsets[i + a] : offsets[i + b]], offsets[i + a : i + b + 1] - offsets[i + a])
                    parts.append(h)
                    sizes.append(n)
                h, n = np.concatenate(parts), np.concatenate(sizes)
                h = np.insert(h, np.cumsum(n), END)
                n = n + 1
                uniq, tokens = np.unique(h, return_inverse=True)
                train = np.repeat(~held[i:j], n)
                counts = np.bincount(tokens[train], minlength=len(uniq))
                blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
                own = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column("doc_id").slice(i, j - i).cast(pa.int64()))
                columns = [pa.array([at]), own, blob(held[i:j], "?"), blob(n, "<i4"), blob(uniq, "<u8"), blob(counts, "<i4"), packed(tokens)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "held", "sizes", "uniq", "counts", "tokens"])
                at += 1

    return materialize(docs.mapInArrow(task, "chunk long, doc_ids array<long>, held binary, sizes binary, uniq binary, counts binary, tokens binary"))


def packed(tokens: np.ndarray) -> pa.Array:
    """Token numbers compressed, as they are stored and shuffled."""
    return pa.array([zstandard.compress(tokens.astype("<u4").tobytes(), 3)], pa.binary())


def tokens_of(row: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(row.column("tokens")[0].as_py()), "<u4").astype(np.int64)


def number(row: pa.RecordBatch, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(row.column(column)[0].as_buffer(), dtype=kind)


def rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


def dealt(chunk: int, keys: np.ndarray, log2: int, **values) -> pa.RecordBatch:
    """Sorted keys and their values cut by the keys' first bits: a row a bucket that has any."""
    bucket = (keys >> np.uint64(64 - log2)).astype(np.int64)
    ends = np.searchsorted(bucket, np.arange((1 << log2) + 1))
    own = np.flatnonzero(np.diff(ends))
    blob = lambda x: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in own], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), chunk)), blob(keys), *map(blob, values.values())], ["bucket", "chunk", "keys", *values])


def pairs_of(row: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """A chunk's distinct pairs: key hashes in order, contexts, tokens, training counts, marks; and each token's pair.

    A pair is marked where a text that is not learned from goes on after it, which may ask for its backoff weight.
    """
    tokens, sizes, uniq = tokens_of(row), number(row, "sizes", "<i4"), number(row, "uniq", "<u8")
    held = number(row, "held", "?")
    before = np.concatenate([[0], tokens[:-1]])
    before[np.cumsum(sizes) - sizes] = np.searchsorted(uniq, END)
    pair, at = np.unique(before * len(uniq) + tokens, return_inverse=True)
    left, right = pair // len(uniq), pair % len(uniq)
    key = mix(uniq[left] * np.uint64(0x9E3779B97F4A7C15) + mix(uniq[right]))
    order = np.argsort(key, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    at = place[at]
    train = np.repeat(~held, sizes)
    counts = np.bincount(at[train], minlength=len(pair))
    asks = ~train
    asks[np.cumsum(sizes) - 1] = False
    marks = np.zeros(len(pair), dtype=bool)
    marks[at[asks]] = True
    return key[order], left[order], right[order], counts, marks, at


def triples_of(row: pa.RecordBatch, key2: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """A chunk's distinct triples: key hashes in order, first pairs, last pairs, training counts; and the triple of each token but a text's first.

    key2 and at are those of pairs_of. A text's first word is no triple: only its start stands before it.
    """
    sizes, held = number(row, "sizes", "<i4"), number(row, "held", "?")
    later = np.ones(len(at), dtype=bool)
    later[np.cumsum(sizes) - sizes] = False
    places = np.flatnonzero(later)
    triple, begin, at3 = np.unique(at[places - 1] * len(key2) + at[places], return_index=True, return_inverse=True)
    first, last = at[places - 1][begin], at[places][begin]
    key = mix(key2[first] * np.uint64(0xD6E8FEB86659FD93) + mix(key2[last] + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    at3 = place[at3]
    counts = np.bincount(at3[np.repeat(~held, sizes)[places]], minlength=len(triple))
    return key[order], first[order], last[order], counts, at3


def summed(requests: DataFrame) -> DataFrame:
    """(chunk, bucket, totals, keys, types, uses, n1..): training counts of the keys over all chunks.

    requests have twice the count, and one more where the chunk marks the key. totals are so too, in the order of the
    chunk's keys, of which there are so many; a key is marked if a chunk marks it. A total is negative in one chunk of
    those that have the key, and so tells its owner. The other columns count the bucket's types: all, their tokens (uses), and those that occur 1, 2, ... times.
    """

    def task(t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in t["keys"]])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in t["counts"]])
        sizes = np.array([len(x.as_buffer()) // 8 for x in t["keys"]])
        uniq, index, at = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(at, counts >> 1).astype(np.int64)
        marked = np.bincount(at, counts & 1) > 0
        first = np.zeros(len(keys), dtype=bool)
        first[index] = True
        ends = np.concatenate([[0], np.cumsum(sizes)])
        each = (2 * total + marked)[at]
        signed = np.where(first, -each, each)
        kind = "<i8" if len(total) and total.max() >= 1 << 30 else "<i4"
        cut = pa.array([zstandard.compress(signed[a:b].astype(kind).tobytes(), 1) for a, b in zip(ends[:-1], ends[1:])], pa.binary())
        stats = [int((total > 0).sum()), int(total.sum())] + [int((total == r).sum()) for r in range(1, K + 2)]
        zero = [0] * (len(sizes) - 1)
        names = ["chunk", "bucket", "totals", "keys", "types", "uses", *[f"n{r}" for r in range(1, K + 2)]]
        return pa.Table.from_arrays([t["chunk"].combine_chunks(), t["bucket"].combine_chunks(), cut, pa.array(ends[1:] - ends[:-1]), *[pa.array([s, *zero], pa.int64()) for s in stats]], names)

    schema = f"chunk long, bucket int, totals binary, keys long, types long, uses long, {_COUNTED}"
    return materialize(requests.groupBy("bucket").applyInArrow(task, schema))


def statistics(answers: DataFrame) -> dict:
    row = answers.agg(*[F.sum(c).alias(c) for c in answers.columns[4:]]).first()
    return {"types": row["types"] or 0, "tokens": row["uses"] or 0, "n": [0] + [row[f"n{r}"] or 0 for r in range(1, K + 2)]}


def bits_for(chunks: DataFrame, column: str, width: int) -> int:
    """So many bits of a key's hash that a bucket gets some BUCKET_ENTRIES keys."""
    entries = (chunks.agg(F.sum(F.octet_length(column))).first()[0] or 0) / width
    return max(3, math.ceil(math.log2(max(1.0, entries / BUCKET_ENTRIES))))


def gathered(t: pa.Table, kind: str) -> pa.Table:
    """A chunk's answers of one kind in order of their buckets."""
    import pyarrow.compute as pc

    return t.filter(pc.equal(t["kind"], kind)).sort_by("bucket")


def totals_of(t: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's totals, whether it owns the key, and whether any chunk marks it; 4 bytes each or 8 where a bucket has larger ones."""
    own = gathered(t, kind)
    raw = [zstandard.decompress(x.as_py()) for x in own["totals"]]
    parts = [np.frombuffer(x, "<i4" if len(x) == 4 * n else "<i8").astype(np.int64) for x, n in zip(raw, own["keys"].to_pylist())]
    signed = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return np.abs(signed) >> 1, signed < 0, (np.abs(signed) & 1).astype(bool)


def joined(t: pa.Table, kind: str, column: str, dtype: str) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in gathered(t, kind)[column]]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def aligned(df: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """df with all of columns (name: type), null where it has none, and its kind."""
    return df.select(F.lit(kind).alias("kind"), *[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def weights(t: pa.Table) -> pa.Table:
    """Backoff weights of the contexts that chunks ask for: mass left over mass of the tokens not seen there."""
    keys, s1, s2, want = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in t[c]]) for c, k in (("keys", "<u8"), ("s1", "<f8"), ("s2", "<f8"), ("want", "?")))
    _, at = np.unique(keys, return_inverse=True)
    alpha = (1 - np.bincount(at, s1)) / (1 - np.bincount(at, s2))
    ends = np.concatenate([[0], np.cumsum([len(x.as_buffer()) // 8 for x in t["keys"]])])
    each = alpha[at]
    out = [each[a:b][want[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pa.table({"chunk": t["chunk"].combine_chunks(), "bucket": t["bucket"].combine_chunks(), "alpha": pa.array(out, pa.binary())})


def weights_of(sums: DataFrame) -> DataFrame:
    """(chunk, bucket, alpha) for requests (bucket, chunk, keys, s1, s2, want), see asked_sums."""
    return sums.groupBy("bucket").applyInArrow(weights, "chunk long, bucket int, alpha binary")


def asked_sums(chunk: int, keys: np.ndarray, bits: int, context: np.ndarray, ahead: np.ndarray, below: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    """Of the contexts (places in keys) whose n-grams the chunk owns, sums of what these have (ahead) and of what the order below gives (below); and which it asks for."""
    s1, s2 = (np.bincount(context, x, minlength=len(keys)) for x in (ahead, below))
    want = np.zeros(len(keys), dtype=bool)
    want[asked] = True
    own = np.flatnonzero((s1 > 0) | want)
    return dealt(chunk, keys[own], bits, s1=s1[own], s2=s2[own], want=want[own])


def score(docs: DataFrame, held) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows of docs (doc_id, text).

    held is a boolean column: such rows are scored but not learned from. Tokens are the words with A-Z lowered and
    one end a text; an end also stands before each text. score is the log10 probability by the Katz model: a triple
    that was seen has its discounted relative frequency; else the weight of its first pair (1 if that was not seen)
    times the probability of its last pair, which is found so from pairs and words. Unknown words have the mass
    that discounting single words left. A text's first token has a pair, with the start, and no triple. base_score is additive
    smoothing by 0.1. A null or blank text is one end. Repeated rows count as rows; a null id counts as its text
    does; other columns are left out; with nothing to learn from both scores are 0. Tokens are told apart by
    64-bit hashes. Sums of floats follow the order of arrival, so reruns may differ in the last bits.
    """
    chunks = coded(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held")))
    word_bits, gram_bits = bits_for(chunks, "uniq", 8), bits_for(chunks, "tokens", 2)

    def ask_words(batches):
        for row in rows_of(batches):
            yield dealt(row.column("chunk")[0].as_py(), number(row, "uniq", "<u8"), word_bits, counts=number(row, "counts", "<i4") * np.int32(2))

    def ask_pairs(batches):
        for row in rows_of(batches):
            key, _, _, counts, marks, _ = pairs_of(row)
            yield dealt(row.column("chunk")[0].as_py(), key, gram_bits, counts=(2 * counts + marks).astype("<i4"))

    def ask_triples(batches):
        for row in rows_of(batches):
            key2, _, _, _, _, at = pairs_of(row)
            key, _, _, counts, _ = triples_of(row, key2, at)
            yield dealt(row.column("chunk")[0].as_py(), key, gram_bits, counts=(2 * counts).astype("<i4"))

    request, own = "bucket int, chunk long, keys binary, counts binary", ["chunk", "held", "sizes", "uniq", "tokens"]
    words = summed(chunks.select("chunk", "uniq", "counts").mapInArrow(ask_words, request))
    pairs = summed(chunks.select(*own).mapInArrow(ask_pairs, request))
    triples = summed(chunks.select(*own).mapInArrow(ask_triples, request))
    one, two, three = statistics(words), statistics(pairs), statistics(triples)
    model = {"n": one["tokens"], "v": one["types"], "one": discounts(one["n"]), "two": discounts(two["n"]), "three": discounts(three["n"])}
    if model["n"]:
        low = [one["n"][r] for r in range(K + 1)]
        rest = one["tokens"] - sum(r * c for r, c in enumerate(low)), one["types"] - sum(low)
        kept = sum(r * c * model["one"][r] for r, c in enumerate(low)) + rest[0] - rest[1] * K * (1 - model["one"][K])
        model["unknown"] = 1 - kept / model["n"]
    else:
        model["unknown"] = 1.0

    def by_pairs(t: pa.Table, row: pa.RecordBatch, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of words the probabilities, of pairs the totals, owners, marks and probabilities if seen, and the contexts whose weights the others need."""
        p = np.where(c > 0, discounted(c, model["one"]) / max(model["n"], 1), model["unknown"])
        c2, first, marked = totals_of(t, "pairs")
        ahead = np.where(c2 > 0, discounted(c2, model["two"]) / np.maximum(c[left], 1), 0.0)
        return p, c2, first, marked, ahead, np.unique(left[(c2 == 0) & (c[left] > 0)])

    def first_part(t: pa.Table) -> pa.Table:
        """What a chunk knows of its words as contexts, and which weights it asks for."""
        row = gathered(t, "chunk").combine_chunks().to_batches()[0]
        c, uniq = totals_of(t, "words")[0], number(row, "uniq", "<u8")
        _, left, right, _, _, _ = pairs_of(row)
        p, c2, first, _, ahead, asked = by_pairs(t, row, c, left, right)
        new = first & (c2 > 0)
        return pa.Table.from_batches([asked_sums(row.column("chunk")[0].as_py(), uniq, word_bits, left[new], ahead[new], p[right[new]], asked)])

    has = {"chunk": "long", "bucket": "int", "doc_ids": "array<long>", **{c: "binary" for c in ("held", "sizes", "uniq", "tokens", "totals")}, "keys": "long", "alpha": "binary"}
    met = aligned(chunks.drop("doc_ids", "counts"), "chunk", has).union(aligned(words, "words", has)).union(aligned(pairs, "pairs", has))
    alphas = materialize(weights_of(met.groupBy("chunk").applyInArrow(first_part, "bucket int, chunk long, keys binary, s1 binary, s2 binary, want binary")))

    def second_part(t: pa.Table) -> pa.Table:
        """All of a chunk's scores but the weights of its pairs, and what it knows and asks of these."""
        row = gathered(t, "chunk").combine_chunks().to_batches()[0]
        c = totals_of(t, "words")[0]
        key2, left, right, _, _, at = pairs_of(row)
        p, c2, _, marked, ahead, asked = by_pairs(t, row, c, left, right)
        weight = np.ones(len(c))
        weight[asked] = joined(t, "alpha", "alpha", "<f8")
        p2 = np.where(c2 > 0, ahead, weight[left] * p[right])
        _, before, last, _, at3 = triples_of(row, key2, at)
        c3, first, _ = totals_of(t, "triples")
        seen = c3 > 0
        ahead = np.where(seen, discounted(c3, model["three"]) / np.maximum(c2[before], 1), p2[last])
        sizes, tokens = number(row, "sizes", "<i4"), tokens_of(row)
        doc, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        later = np.ones(len(tokens), dtype=bool)
        later[begin] = False
        each = np.empty(len(tokens))
        each[begin], each[later] = np.log10(p2[at[begin]]), np.log10(ahead)[at3]
        base = np.log10((c + 0.1) / (model["n"] + 0.1 * (model["v"] + 1)))
        by_doc = lambda x: np.bincount(doc, x, minlength=len(sizes))
        backs = ~seen & (c2[before] > 0)
        backed = backs[at3]
        asked, place = np.unique(before[at3[backed]], return_inverse=True)
        new = first & seen & marked[before]
        chunk = row.column("chunk")[0].as_py()
        sums = asked_sums(chunk, key2, gram_bits, before[new], ahead[new], p2[last[new]], asked)
        blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        mine = {"chunk": pa.array([chunk]), "doc_ids": row.column("doc_ids"), "held": row.column("held"), "sizes": row.column("sizes")}
        mine |= {"known": blob(by_doc(c[tokens] > 0), "<i4"), "base": blob(by_doc(base[tokens]), "<f8"), "partial": blob(by_doc(each), "<f8"), "backed": blob(doc[later][backed], "<i4"), "asked": blob(place, "<i4")}
        return pa.concat_tables([pa.table(mine), pa.Table.from_batches([sums])], promote_options="default").select(names)

    names = ["bucket", "chunk", "keys", "s1", "s2", "want", "doc_ids", "held", "sizes", "known", "base", "partial", "backed", "asked"]
    kinds = {c: "binary" for c in names} | {"bucket": "int", "chunk": "long", "doc_ids": "array<long>"}
    met = aligned(chunks.drop("counts"), "chunk", has)
    for kind, answers in (("words", words), ("pairs", pairs), ("triples", triples), ("alpha", alphas)):
        met = met.union(aligned(answers, kind, has))
    parts = materialize(met.groupBy("chunk").applyInArrow(second_part, ", ".join(f"{c} {t}" for c, t in kinds.items())))
    discard(chunks, words, pairs, triples, alphas)

    def last_part(t: pa.Table) -> pa.Table:
        row = gathered(t, "chunk").combine_chunks().to_batches()[0]
        alpha = joined(t, "alpha", "alpha", "<f8")
        sizes, doc, place = number(row, "sizes", "<i4"), number(row, "backed", "<i4"), number(row, "asked", "<i4")
        total = number(row, "partial", "<f8") + np.bincount(doc, np.log10(alpha[place]) if len(place) else None, minlength=len(sizes))
        n = len(sizes)
        return pa.table({"doc_id": row.column("doc_ids").flatten(), "held_out": pa.array(number(row, "held", "?")), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(number(row, "known", "<i4").astype(np.int64)), "train_tokens": pa.array(np.full(n, model["n"])), "base_score": pa.array(number(row, "base", "<f8")), "score": pa.array(total)})

    pair_alphas = weights_of(parts.filter("bucket is not null").select("bucket", "chunk", "keys", "s1", "s2", "want"))
    has = {"chunk": "long", "bucket": "int", "doc_ids": "array<long>", **{c: "binary" for c in ("held", "sizes", "known", "base", "partial", "backed", "asked", "alpha")}}
    met = aligned(parts.filter("bucket is null"), "chunk", has).union(aligned(pair_alphas, "alpha", has))
    return met.groupBy("chunk").applyInArrow(last_part, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, remainder("doc_id", 10) == 0)
