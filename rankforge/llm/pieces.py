"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, steps, table, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of candidate merges that are skipped, and the seed.
DROPOUT, SEED = 0.1, 17
#: Runs of merges that a task remembers.
REMEMBERED = 300_000
#: Symbols up to which the next merge is found by scanning; longer chunks keep an agenda in a heap.
SCANNED = 64
#: No merge crosses the end of a chunk: spaces with the word behind them, line feeds, spaces at a line's end.
CHUNK = re.compile(r"\n| *[^ \n]+| +")
SPACE = "▁"
_MASK = 0xFFFFFFFF
PIECES, NO_MERGE = 1 << 20, 1 << 30
#: Bits of the hash by which a pair of pieces is looked up.
SLOT_BITS = 20


def load_model(path: str = MODEL) -> dict:
    """What encoding and decoding need of a BPE model with byte fallback, read by the driver (some 32,000 pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    merges, singles, byte_ids, texts = {}, {}, [0] * 256, []
    for i in range(len(sp)):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(SPACE, " ").encode())
            merges[piece] = (-sp.get_score(i), i)
            singles[piece] = i
    single = sorted((ord(p), i) for p, i in singles.items() if len(p) == 1 and p != SPACE)
    single = sorted([*single, (ord(" "), singles[SPACE])])
    pairs = sorted((singles[p[:k]] * PIECES + singles[p[k:]], i, r) for p, (r, i) in merges.items() for k in range(1, len(p)) if p[:k] in singles and p[k:] in singles)
    order = {r: n for n, r in enumerate(sorted({r for r, _ in merges.values()}))}
    tables = {"points": np.array([c for c, _ in single], np.uint32), "point_ids": np.array([i for _, i in single], np.int64)}
    tables |= {"pairs": np.array([k for k, *_ in pairs], np.int64), "pair_ids": np.array([i for _, i, _ in pairs], np.int32), "pair_ranks": np.array([order[r] for *_, r in pairs], np.int32)}
    return {"merges": merges, "ids": singles, "bytes": byte_ids, "texts": texts, "tables": tables}


class Grown:
    """An array that values are added to at its end, in place while there is room."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            self.room = np.concatenate([self.values, np.zeros(2 * size - self.size, self.room.dtype)])
        self.room[self.size : size] = values
        self.size = size

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class Encoder:
    """Segments occurrences of chunks, each by a hash base of its own, over a tree of runs that all of them share.

    A run is the merges of a chunk, in order, when some candidates are known to be skipped. It does not depend on
    candidates that never come first, so an occurrence that skips none of a run's merges has the run's pieces;
    else it goes on with the run in which the first merge it skips is known to be skipped as well. Runs hold no
    hashes: they are tables of candidates, and dropping them changes no result.
    """

    def __init__(self, model: dict, variant: int, dropout: float, seed: int, remembered: int = REMEMBERED):
        self.merges, self.ids, self.byte_ids, self.remembered = model["merges"], model["ids"], model["bytes"], remembered
        self.key, self.limit = (seed * 1_000_003 + variant) & _MASK, int(dropout * (1 << 24))
        self.known: dict[str, bytes] = {}
        self.tables = model["tables"]
        # pairs by hash: a pair's number in its slot; a slot that several pairs share is searched instead
        at = self.slot(self.tables["pairs"])
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[at] = np.arange(len(at))
        self.crowded = np.bincount(at, minlength=1 << SLOT_BITS) > 1
        self.forget()

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.chunks: list[str] = []
        # a run: its chunk, the run it comes from, the candidate skipped since, its pieces and its merges
        self.held = {name: Grown(np.int32 if name == "pool" else np.int64) for name in ("chunk", "parent", "via", "start", "size", "first", "merged", "pool", "made", "child")}
        self.add()

    def add(self, **values: np.ndarray) -> None:
        """Adds values to the columns of the runs, which are then seen under their names."""
        for name, held in self.held.items():
            if name in values:
                held.add(values[name])
            setattr(self, name, held.values)

    def look_up(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of all these chunks, hashed by the chunk alone."""
        own = list(chunks)
        return dict(zip(own, self.encode_all(own)))

    def encode_all(self, chunks: list[str]) -> list[bytes]:
        """As encode, over many chunks at once."""
        bases = np.fromiter((zlib.crc32(c.encode(), self.key) for c in chunks), np.uint32, len(chunks))
        ids, counts = self.segments(chunks, bases)
        ends = np.cumsum(counts)
        return [ids[a:b].astype("<i4").tobytes() for a, b in zip(ends - counts, ends)]

    def segments(self, chunks: list[str], bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences, one after the other, and how many each has."""
        if len(self.start) > self.remembered:
            self.forget()
        new = [c for c in set(chunks) if c not in self.roots]
        short = [c for c in new if len(c) <= SCANNED]
        self.roots.update(dict.fromkeys(new, -1))
        begin = len(self.chunks)
        self.chunks += short
        none = np.full(len(short), -1, np.int64)
        self.roots.update(zip(short, self.grow(np.arange(begin, len(self.chunks)), none, none).tolist()))
        node = np.fromiter(map(self.roots.__getitem__, chunks), np.int64, len(chunks))
        active = np.flatnonzero(node >= 0) if self.limit else np.zeros(0, np.int64)
        while len(active):
            own = node[active]
            n = self.merged[own]
            owner = np.repeat(np.arange(len(active)), n)
            at = np.arange(len(owner)) + np.repeat(self.first[own] - np.cumsum(n) + n, n)
            skip = np.flatnonzero(self.skipped(bases[active][owner], self.made[at]))
            who, first = np.unique(owner[skip], return_index=True)
            active, at = active[who], at[skip[first]]
            missing, one = np.unique(at[self.child[at] < 0], return_index=True)
            if len(missing):
                parents = own[who][self.child[at] < 0][one]
                self.child[missing] = -2  # grown next; grow appends to child
                grown = self.grow(self.chunk[parents], parents, self.made[missing])
                self.child[missing] = grown
            node[active] = self.child[at]
        fast, slow = np.flatnonzero(node >= 0), np.flatnonzero(node < 0).tolist()
        counts = np.zeros(len(chunks), np.int64)
        counts[fast] = self.size[node[fast]]
        found = [self.encode(chunks[k], int(bases[k])) for k in slow]
        counts[slow] = [len(x) for x in found]
        ends = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int32)
        n = counts[fast]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat((ends - counts)[fast], n) + within] = self.pool[np.repeat(self.start[node[fast]], n) + within]
        for k, x in zip(slow, found):
            out[ends[k] - len(x) : ends[k]] = x
        return out, counts

    def skipped(self, base: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether the keyed hash skips candidate merges, given as place * PIECES + piece."""
        h = base + (code // PIECES).astype(np.uint32) * np.uint32(0x9E3779B1) + (code % PIECES).astype(np.uint32) * np.uint32(0x85EBCA77)
        h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        h = (h ^ h >> np.uint32(12)) * np.uint32(0x297A2D39)
        return (h ^ h >> np.uint32(15)) >> np.uint32(8) < self.limit

    def grow(self, chunk: np.ndarray, parent: np.ndarray, via: np.ndarray) -> np.ndarray:
        """Adds runs of chunks, given by number; their own numbers, -1 for chunks with a character that is no piece."""
        out = np.full(len(chunk), -1, np.int64)
        drops, above = [via], parent
        while len(above) and (above >= 0).any():
            drops.append(np.where(above >= 0, self.via[above], -1))
            above = np.where(above >= 0, self.parent[above], -1)
        drops = np.stack(drops, axis=1)
        texts = [self.chunks[i] for i in chunk.tolist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(sizes, kind="stable")
        parts, n_runs, n_pool, n_made = [], len(self.start), len(self.pool), len(self.made)
        for k in range(0, len(order), 4096):
            own = order[k : k + 4096]
            ids, fine, made = self.rounds([texts[i] for i in own.tolist()], sizes[own], drops[own])
            own, ids, made = own[fine], ids[fine], made[fine]
            size, merged = (ids >= 0).sum(axis=1), (made >= 0).sum(axis=1)
            start, first = n_pool + np.cumsum(size) - size, n_made + np.cumsum(merged) - merged
            out[own] = n_runs + np.arange(len(own))
            parts.append((chunk[own], parent[own], via[own], start, size, first, merged, ids[ids >= 0].astype(np.int32), made[made >= 0]))
            n_runs, n_pool, n_made = n_runs + len(own), n_pool + int(size.sum()), n_made + int(merged.sum())
        if parts:
            names = ("chunk", "parent", "via", "start", "size", "first", "merged", "pool", "made")
            more = dict(zip(names, (np.concatenate(x) for x in zip(*parts))))
            self.add(**more, child=np.full(len(more["made"]), -1, np.int64))
        return out

    def rounds(self, chunks: list[str], sizes: np.ndarray, drops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of chunks, all at once: in each round every chunk makes its best merge that is not in its row of drops.

        Gives pieces, whether all characters are pieces, and the merges made; -1 where a row has no more.
        """
        t = self.tables
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype="<u4")
        at = np.minimum(np.searchsorted(t["points"], points), len(t["points"]) - 1)
        single = np.where(t["points"][at] == points, t["point_ids"][at], -2)
        width = int(sizes.max())
        ids = np.full((len(chunks), width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = single
        fine = ~(ids == -2).any(axis=1)
        result, made = ids.copy(), np.full((len(chunks), width), -1, dtype=np.int64)  # codes need 64 bits
        rows = np.flatnonzero(fine & (sizes > 1))
        ids, drops = ids[rows], drops[rows]
        place = np.broadcast_to(np.arange(width, dtype=np.int32), ids.shape).copy()
        if not len(rows):
            return result, fine, made
        ranks, merged = self.ranked(ids[:, :-1], ids[:, 1:], place[:, :-1], drops[:, None])
        turn = 0
        while len(rows):
            best = ranks.argmin(axis=1)
            go = ranks[np.arange(len(rows)), best] < NO_MERGE
            if not go.all():
                result[rows[~go]] = -1
                result[rows[~go], : ids.shape[1]] = ids[~go]
                rows, ids, place, ranks, merged, drops, best = rows[go], ids[go], place[go], ranks[go], merged[go], drops[go], best[go]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            made[rows, turn] = place[each, best].astype(np.int64) * PIECES + merged[each, best]
            turn += 1
            ids[each, best] = merged[each, best]
            width = ids.shape[1] - 1
            columns = np.arange(width)
            move = columns + (columns > best[:, None])
            move += each[:, None] * ids.shape[1]
            ids, place = ids.take(move), place.take(move)
            if width == 1:
                result[rows] = -1
                result[rows, 0] = ids[:, 0]
                break
            pairs = np.minimum(columns[:-1] + (columns[:-1] >= best[:, None]), width - 1)
            pairs += each[:, None] * ranks.shape[1]
            ranks, merged = ranks.take(pairs), merged.take(pairs)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                i = side[ok]
                ranks[ok, i], merged[ok, i] = self.ranked(ids[ok, i], ids[ok, i + 1], place[ok, i], drops[ok])
        return result, fine, made

    def ranked(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, drops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Priorities and pieces of candidate merges; NO_MERGE where there is none or it is among drops."""
        t = self.tables
        key = left.astype(np.int64) * PIECES + right
        slot = self.slot(key)
        i = self.slots[slot]
        there = t["pairs"][i] == key
        again = np.nonzero(self.crowded[slot] & ~there)
        if len(again[0]):
            i[again] = np.minimum(np.searchsorted(t["pairs"], key[again]), len(t["pairs"]) - 1)
            there[again] = t["pairs"][i[again]] == key[again]
        there &= (left >= 0) & (right >= 0)
        piece = t["pair_ids"][i]
        code = at.astype(np.int64) * PIECES + piece
        for k in range(drops.shape[-1]):
            there &= code != drops[..., k]
        return np.where(there, t["pair_ranks"][i], NO_MERGE), piece

    def encode(self, chunk: str, base: int | None = None) -> list[int]:
        """The ids of one occurrence; without a base, hashed by the chunk alone."""
        # a U+2581 of the text itself goes by bytes, as its piece means a space
        symbols = ["\0" if c == SPACE else SPACE if c == " " else c for c in chunk]
        literal = SPACE in chunk or "\0" in chunk
        base = zlib.crc32(chunk.encode(), self.key) if base is None else base
        symbols = (self.scan if len(symbols) <= SCANNED else self.agenda)(symbols, base)
        out, at = [], 0
        for s in symbols:
            i = self.ids.get(s)
            if i is None or literal and s == "\0":
                out += [self.byte_ids[b] for c in chunk[at : at + len(s)] for b in c.encode()]
            else:
                out.append(i)
            at += len(s)
        return out

    def rank(self, left: str, right: str, at: int, base: int) -> float | None:
        """The priority of a candidate merge; None if no piece comes of it or its keyed hash says to skip it."""
        got = self.merges.get(left + right)
        if got is None:
            return None
        if self.limit:
            h = (base + at * 0x9E3779B1 + got[1] * 0x85EBCA77) & _MASK
            h = ((h ^ h >> 15) * 0x2C1B3C6D) & _MASK
            h = ((h ^ h >> 12) * 0x297A2D39) & _MASK
            if (h ^ h >> 15) >> 8 < self.limit:
                return None
        return got[0]

    def scan(self, symbols: list[str], base: int) -> list[str]:
        none = float("inf")
        rank = self.rank
        at = list(range(len(symbols)))
        ranks = [none if (r := rank(symbols[i], symbols[i + 1], i, base)) is None else r for i in range(len(symbols) - 1)]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i], at[i + 1]
            if i < len(ranks):
                ranks[i] = none if (r := rank(symbols[i], symbols[i + 1], at[i], base)) is None else r
            if i:
                ranks[i - 1] = none if (r := rank(symbols[i - 1], symbols[i], at[i - 1], base)) is None else r
        return symbols

    def agenda(self, symbols: list[str], base: int) -> list[str]:
        n = len(symbols)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [len(s) for s in symbols]
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := self.rank(symbols[i], symbols[j], i, base)) is not None:
                heapq.heappush(heap, (r, i, size[i], size[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if size[i] != left or j >= n or size[j] != right:
                continue  # one of the two has been merged since
            symbols[i] += symbols[j]
            size[i], size[j], symbols[j] = left + right, 0, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]


class Both(dict):
    """Looks into a second dict for what the first does not have."""

    def __init__(self, first: dict, second: dict):
        super().__init__(first)
        self.second = second

    def __missing__(self, key):
        return self.second[key]


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, by: tuple[str, ...] | None = None) -> DataFrame:
    """docs with ids: the pieces of text, one merge in 1 / dropout skipped.

    A merge is skipped where a hash of seed, row, the chunk's position in the text, place and piece falls under
    dropout, so a rerun agrees, another seed segments anew, and each occurrence of a word is segmented for itself.
    The row enters by its text and the columns in by (doc_id, if there is one): texts that differ in them come out
    differently. With dropout 0 the ids are the model's own. As the model does, one space is put before a text,
    but nothing before an empty one. A null text has null ids, an empty one none. Other columns stay, repeated
    rows too; a column named ids is replaced; an empty table stays empty.
    """
    base = docs.drop("ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    names = base.columns
    by = [c for c in ("doc_id",) if c in names] if by is None else by
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model))

    def task(batches):
        own = Encoder(shared.value, 0, dropout, seed)
        for batch in batches:
            _, offsets = text_buffers(batch.column(text))
            for i, j in steps(offsets):
                part = batch.slice(i, j - i)
                split = [CHUNK.findall(" " + t) if t else [] for t in part.column(text).to_pylist()]
                n = np.fromiter(map(len, split), np.int64, len(split))
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = part.column("_row").to_numpy().view(np.uint64)
                bases = (mix(np.repeat(row, n) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
                values, sizes = own.segments([c for t in split for c in t], bases)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])]
                nulls = part.column(text).is_null()
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=nulls)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], ids], [*names, "ids"])

    return base.withColumn("_row", F.xxhash64(F.lit(seed), *by, text)).mapInArrow(task, f"{fields}, ids array<int>")


def decode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with decoded in place of ids: the text of the pieces, byte pieces joined, without the space in front."""
    base = docs.drop("decoded")
    names = [c for c in base.columns if c != "ids"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "ids")
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model)["texts"])

    def task(batches):
        texts, nothing = pa.array(shared.value, pa.large_binary()), pa.scalar(None, pa.large_string())
        for batch in batches:
            ids = batch.column("ids")
            runs = pa.ListArray.from_arrays(ids.offsets, texts.take(ids.values))
            joined = pc.binary_join(runs, pa.scalar(b"", pa.large_binary())).cast(pa.large_string())
            decoded = pc.if_else(ids.is_null(), nothing, pc.utf8_slice_codeunits(joined, 1)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], decoded], [*names, "decoded"])

    return base.mapInArrow(task, f"{fields + ', ' if fields else ''}decoded string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs).withColumn("text_sha256", F.sha2("text", 256)).drop("text")
    ids = ids.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long")).withColumn("ids_hash", F.xxhash64("ids"))
    out = decode(ids)
    return out.select("doc_id", "n_tokens", "ids_hash", F.sha2("decoded", 256).alias("decoded_sha256"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("lossless"))
