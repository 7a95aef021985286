"""Media columns: texts kept as lossless WebP images, and a full decoder of lossless WebP."""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_buffers

#: Samples in a row of pixels at least, the format's largest side, and its longest copy.
ROW, SIDE, LONGEST = 64, 16384, 4096
#: Shortest copy the writer makes, and its longest prefix code.
COPY, CODE_BITS = 8, 11
#: Samples in which the writer looks for copies.
BLOCK = 1 << 15
#: Samples, tokens or bits of a stream that are handled at once, so that memory does not grow with a text's length.
AT_ONCE = 1 << 20
# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE = 0x2F
#: Near neighbours by distance code: nearer ones first, then by |x|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

# --- writing ----------------------------------------------------------------------------------------


def reversed_bits(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits reversed."""
    x = np.arange(1 << n, dtype=np.uint32)
    out = np.zeros_like(x)
    for i in range(n):
        out |= ((x >> i) & 1) << (n - 1 - i)
    return out


REVERSED = [reversed_bits(n) for n in range(16)]
_REVERSED = [x.tolist() for x in REVERSED[:12]]


class Bits:
    """Fields of a header, least bit first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> Bits:
        self.value |= value << self.n
        self.n += n
        return self


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of an optimal prefix code, 0 for symbols that do not occur; flatter counts if one is longer than most."""
    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    if len(used) < 2:
        return lengths
    weights = [counts[s] for s in used]
    while True:
        leaves, inner, i, j = sorted(w << 20 | k for k, w in enumerate(weights)), [], 0, 0
        above, made, mask = [0] * (2 * len(used) - 1), len(used), (1 << 20) - 1
        for _ in range(len(used) - 1):
            total = 0
            for _ in range(2):  # the lighter of the next leaf and the next joined pair, twice
                if j >= len(inner) or i < len(leaves) and leaves[i] <= inner[j]:
                    w = leaves[i]
                    i += 1
                else:
                    w = inner[j]
                    j += 1
                total += w >> 20
                above[w & mask] = made
            inner.append(total << 20 | made)
            made += 1
        depth = [0] * made
        for node in range(made - 2, -1, -1):
            depth[node] = depth[above[node]] + 1
        if max(depth[: len(used)]) <= most:
            break
        weights = [(w + 1) // 2 for w in weights]
    for s, d in zip(used, depth):
        lengths[s] = d
    return lengths


def canonical(lengths: list[int]) -> list[int]:
    """The codes that lengths stand for, first bit lowest."""
    codes, code, last = [0] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        codes[s] = _REVERSED[n][code]
        code, last = code + 1, n
    return codes


def put_code(bits: Bits, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the prefix code for symbols that occur so often; codes and their lengths."""
    counts = counts.tolist()
    used = [s for s, c in enumerate(counts) if c] or [0]
    if len(used) == 1:
        bits.put(1, 1).put(0, 1).put(1, 1).put(used[0], 8)  # one symbol, no bits
        return np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
    lengths = code_lengths(counts, CODE_BITS)
    tokens = []  # lengths with runs: (symbol, extra, bits of extra)
    for n, run in groupby(lengths):
        left = len(list(run))
        if n:
            tokens.append((n, 0, 0))
            left -= 1
        while left >= 3:
            take = min(left, 6 if n else 138)
            tokens.append((16, take - 3, 2) if n else (17, take - 3, 3) if take < 11 else (18, take - 11, 7))
            left -= take
        tokens += [(n, 0, 0)] * left
    own = [0] * 19
    for t, *_ in tokens:
        own[t] += 1
    if sum(c > 0 for c in own) == 1:
        own[0 if not own[0] else 1] += 1  # a code of one symbol would have no bits to read
    short = code_lengths(own, 7)
    codes = canonical(short)
    count = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if short[s]))
    bits.put(0, 1).put(count - 4, 4)
    for s in CODE_LENGTH_ORDER[:count]:
        bits.put(short[s], 3)
    bits.put(0, 1)
    for t, extra, n in tokens:
        bits.put(codes[t] | extra << short[t], short[t] + n)
    return np.array(canonical(lengths), np.uint64), np.array(lengths, np.int64)


def copies(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies, in order: where COPY samples stood before, for as long as they go on alike."""
    n = len(px) - COPY + 1
    if n < 2:
        return []
    keys = np.ndarray((n,), "<u8", np.ascontiguousarray(px), strides=(1,))
    order = np.argsort((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")
    back = np.zeros(n, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    begin = np.flatnonzero(np.concatenate([[True], back[1:] != back[:-1]]))
    ends = np.concatenate([begin[1:], [n]])
    some = back[begin] > 0
    out, at = [], 0
    for s, e, d in zip(begin[some].tolist(), ends[some].tolist(), back[begin[some]].tolist()):
        s, e = max(s, at), e + COPY - 1
        while e - s >= COPY:
            k = min(e - s, LONGEST)
            out.append((s, k, d))
            s = at = s + k
    return out


def prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and its number of bits of lengths or distances."""
    x = v - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1)), x & ((1 << extra) - 1), extra


def spread(value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The bits of all values, first bit first; values have 46 bits at most, so that they fit into 64 when shifted."""
    out = []
    for k in range(0, len(value), AT_ONCE // 8):
        v, w = value[k : k + AT_ONCE // 8], width[k : k + AT_ONCE // 8]
        ends = np.cumsum(w)
        start = ends - w
        total = int(ends[-1])
        words = np.zeros(total // 16 + 5)
        v, at = v << (start & 15).astype(np.uint64), start >> 4
        while len(v):  # sixteen bits at a time; no two values share a bit
            words += np.bincount(at, (v & np.uint64(0xFFFF)).astype(np.float64), minlength=len(words))
            v = v >> np.uint64(16)
            more = v > 0
            v, at = v[more], at[more] + 1
        out.append(np.unpackbits(words.astype("<u2").view(np.uint8), bitorder="little")[:total])
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def put_pixels(bits: Bits, green: np.ndarray, alpha: int, main: bool) -> np.ndarray:
    """Writes the header of an image whose pixels differ in green only to bits; gives the bits of its pixels."""
    bits.put(0, 1)  # no colour cache: a pixel of one sample is no longer than its place in a cache
    if main:
        bits.put(0, 1)  # one group of codes
    found = [(k + i, n, d) for k in range(0, len(green), BLOCK) for i, n, d in copies(green[k : k + BLOCK])]
    place, size, back = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
    inside = np.zeros(len(green) + 1, np.int64)
    np.add.at(inside, place, 1)
    np.add.at(inside, place + size, -1)
    starts = np.cumsum(inside[:-1]) == 0
    starts[place] = True
    at = np.flatnonzero(starts)
    symbol = green[at].astype(np.int64)
    copy = np.searchsorted(at, place)
    length, length_extra, length_bits = prefixed(size)
    far, far_extra, far_bits = prefixed(back + len(NEAR))
    symbol[copy] = 256 + length
    codes, lengths = put_code(bits, np.bincount(symbol, minlength=280))
    for only in (0, 0, alpha):
        bits.put(1, 1).put(0, 1).put(1, 1).put(only, 8)
    far_codes, far_lengths = put_code(bits, np.bincount(far, minlength=40))
    value, width = codes[symbol], lengths[symbol]
    for part, n in ((length_extra, length_bits), (far_codes[far], far_lengths[far]), (far_extra, far_bits)):
        value[copy] |= part.astype(np.uint64) << width[copy].astype(np.uint64)
        width[copy] += n
    return spread(value, width)


def entropy(x: np.ndarray) -> float:
    """Bits that an ideal prefix code takes for all of x."""
    c = np.bincount(x, minlength=1)
    c = c[c > 0]
    return float(len(x) * np.log2(len(x)) - (c * np.log2(c)).sum())


def encode(payload: np.ndarray) -> bytes:
    """A WebP file whose pixels hold payload (a multiple of 64 bytes), a sample a pixel, in green.

    Up to 16 different samples make a palette, several of them a pixel. Where differences to the left neighbour
    take fewer bits than samples, the predictor transform stores those. What stood before is copied; the rest has
    a prefix code. ValueError above the format's 16384 * 16384 pixels.
    """
    row = ROW
    while len(payload) > row * SIDE:
        row *= 2
    if row > SIDE:
        raise ValueError("the payload does not fit into one image")
    height = -(-len(payload) // row)
    if height * row > len(payload):
        payload = np.concatenate([payload, np.zeros(height * row - len(payload), np.uint8)])
    bits = Bits().put(SIGNATURE, 8).put(row - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)
    parts, alpha, px = [], 255, payload
    count = np.bincount(payload, minlength=256)
    used = np.flatnonzero(count)

    def flush(body: np.ndarray) -> None:
        head = np.unpackbits(np.frombuffer(bits.value.to_bytes(bits.n // 8 + 1, "little"), np.uint8), bitorder="little")[: bits.n]
        parts.extend((head, body))
        bits.value = bits.n = 0

    if len(used) <= 16:
        bits.put(1, 1).put(3, 2).put(len(used) - 1, 8)
        steps = np.diff(used, prepend=0).astype(np.uint8)
        flush(put_palette(bits, steps))
        index = np.zeros(256, np.uint8)
        index[used] = np.arange(len(used))
        each = 8 if len(used) <= 2 else 4 if len(used) <= 4 else 2
        packed = index[payload].reshape(-1, each) << (np.arange(each) * (8 // each)).astype(np.uint8)
        px, alpha = np.bitwise_or.reduce(packed, axis=1).astype(np.uint8), 255
    else:
        grid = payload.reshape(height, row)
        left = np.diff(grid, axis=1, prepend=np.uint8(0))
        left[1:, 0] = np.diff(grid[:, 0])
        if entropy(left.ravel()) + 512 < entropy(payload):
            bits.put(1, 1).put(0, 2).put(7, 3)
            blocks = np.ones(-(-row // 512) * -(-height // 512), np.uint8)  # mode 1: left
            flush(put_pixels(bits, blocks, 0, False))
            px, alpha = left.ravel(), 0
    bits.put(0, 1)  # no further transform
    flush(put_pixels(bits, px, alpha, True))
    chunk = np.packbits(np.concatenate(parts), bitorder="little").tobytes()
    padded = chunk + b"\0" * (len(chunk) % 2)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + padded


def put_palette(bits: Bits, steps: np.ndarray) -> np.ndarray:
    """Writes a palette of grey-green colours, opaque, as differences: the first has alpha, the others none."""
    bits.put(0, 1)
    codes, lengths = put_code(bits, np.bincount(steps, minlength=280))
    for _ in range(2):
        bits.put(1, 1).put(0, 1).put(1, 1).put(0, 8)
    first = np.zeros(256, np.int64)
    first[255], first[0] = 1, len(steps) - 1
    alpha_codes, alpha_lengths = put_code(bits, first)
    put_code(bits, np.zeros(40, np.int64))
    alpha = np.where(np.arange(len(steps)) == 0, 255, 0)
    value = codes[steps] | alpha_codes[alpha] << lengths[steps].astype(np.uint64)
    width = lengths[steps] + alpha_lengths[alpha]
    return spread(value, width)


# --- reading ----------------------------------------------------------------------------------------


class Reader:
    """Bits of a stream, least bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        self.fill(n)
        return self.held & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        out = self.peek(n)
        self.held >>= n
        self.n -= n
        return out

    def fill(self, n: int) -> None:
        while self.n < n:
            chunk = self.data[self.at : self.at + 8]
            self.at += 8
            self.held |= int.from_bytes(chunk, "little") << self.n
            self.n += 64  # zeros stand behind the end
            if self.at > len(self.data) + 64:
                raise ValueError("the stream ends early")

    def seek(self, at: int) -> None:
        self.at, self.held, self.n = at // 8, 0, 0
        if at % 8:
            self.bits(at % 8)

    def position(self) -> int:
        return self.at * 8 - self.n


class Code:
    """A canonical prefix code given by the lengths of its symbols."""

    def __init__(self, lengths):
        self._table = None
        if isinstance(lengths, int):  # a code of this one symbol
            self.only, self.bits = lengths, 0
            return
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.used = np.flatnonzero(self.lengths)
        self.only = int(self.used[0]) if len(self.used) == 1 else None if len(self.used) else 0
        self.bits = 0 if self.only is not None else int(self.lengths.max())
        if self.only is None and (1 << 15 - self.lengths[self.used]).sum() != 1 << 15:
            raise ValueError("the prefix code is not complete")

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their lengths by the next bits of the stream."""
        if self._table is None:
            if self.only is not None:
                self._table = np.array([self.only], np.int32), np.zeros(1, np.int32)
            else:
                # in order of codes, each symbol takes 2**(bits - length) entries by bits read highest first
                order = self.used[np.argsort(self.lengths[self.used], kind="stable")]
                n = self.lengths[order]
                by_code = np.repeat(np.arange(len(order)), 1 << self.bits - n)[REVERSED[self.bits]]
                self._table = order[by_code].astype(np.int32), n[by_code].astype(np.int32)
        return self._table

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        symbols, lengths = self.table()
        i = r.peek(self.bits)
        r.bits(int(lengths[i]))
        return int(symbols[i])


def read_code(r: Reader, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if r.bits(1):
        two, first = r.bits(1), r.bits(8 if r.bits(1) else 1)
        if not two:
            return Code(first)
        lengths[first] = lengths[r.bits(8)] = 1
        return Code(lengths)
    own, count = [0] * 19, 4 + r.bits(4)
    triples = r.bits(3 * count)
    for i in range(count):
        own[CODE_LENGTH_ORDER[i]] = triples >> 3 * i & 7
    most = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    symbols, sizes = (x.tolist() for x in Code(own).table())
    mask, at = len(symbols) - 1, r.position()
    ahead, p = int.from_bytes(r.data[at // 8 : at // 8 + 2 * alphabet + 8], "little") >> at % 8, 0  # 14 bits a symbol at most
    s, last = 0, 8
    while s < alphabet and most:
        most -= 1
        n = ahead >> p & mask
        p, n = p + sizes[n], symbols[n]
        if n < 16:
            lengths[s] = n
            s, last = s + 1, n or last
            continue
        value, least, bits = (last, 3, 2) if n == 16 else (0, 3, 3) if n == 17 else (0, 11, 7)
        times = least + (ahead >> p & (1 << bits) - 1)
        p += bits
        if s + times > alphabet:
            raise ValueError("too many code lengths")
        lengths[s : s + times] = [value] * times
        s += times
    r.seek(at + p)
    return Code(lengths)


def extended(r: Reader, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """The ARGB numbers of an entropy-coded image."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    groups, number, bits = 1, None, 0
    if main and r.bits(1):
        bits = r.bits(3) + 2
        wide = -(-width // (1 << bits))
        number = (read_pixels(r, wide, -(-height // (1 << bits)), False) >> 8 & 0xFFFF).reshape(-1, wide)
        groups = int(number.max()) + 1
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(r, n) for n in (280 + cached, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cached:
        return tabled_pixels(r, codes[0], width, total)
    out, cache, i = [0] * total, [0] * cached, 0
    seen = 0  # pixels before this one are in the colour cache
    while i < total:
        own = codes[0 if number is None else int(number[(i // width) >> bits, (i % width) >> bits])]
        green = own[0].read(r)
        if green < 256:
            red, blue, alpha = own[1].read(r), own[2].read(r), own[3].read(r)
            out[i] = alpha << 24 | red << 16 | green << 8 | blue
            i += 1
        elif green < 280:
            length = extended(r, green - 256)
            code = extended(r, own[4].read(r))
            if code > 120:
                back = code - 120
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * width)
            if back > i or i + length > total:
                raise ValueError("a copy reaches out of the image")
            for j in range(i, i + length):
                out[j] = out[j - back]
            i += length
        else:
            while seen < i:
                cache[(0x1E35A7BD * out[seen] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[seen]
                seen += 1
            if green - 280 >= cached:
                raise ValueError("no such cache entry")
            out[i] = cache[green - 280]
            i += 1
    return np.array(out, dtype=np.uint32)


#: What lengths and distances start from and how many more bits they have, by prefix symbol.
EXTRA = np.array([max(0, (k - 2) >> 1) for k in range(40)])
FROM = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)])
_NEAR = np.array(NEAR)


def tabled_pixels(r: Reader, codes: list[Code], width: int, total: int) -> np.ndarray:
    """All pixels of an image with one group of codes and no cache.

    What would be read is looked up in tables for every bit of the stream at once, with the bit at which the next
    pixel or copy begins. Those that are read are then followed from the first, and copies resolved by halving
    the way back to the pixel that they come from.
    """
    green, red, blue, alpha, far = (c.table() for c in codes)
    masks = [(1 << c.bits) - 1 for c in codes]
    only = [c.only for c in codes]
    if all(x is not None for x in only[:4]) and only[0] < 256:
        return np.full(total, only[3] << 24 | only[1] << 16 | only[0] << 8 | only[2], np.uint32)
    at = r.position()
    data = np.frombuffer(r.data + b"\0" * 32, np.uint8)
    end, parts, left = len(r.data) * 8, [], total
    while left > 0:
        if at >= end:
            raise ValueError("the stream ends early")
        raw = data[at // 8 : (at // 8) + AT_ONCE // 8 + 32]
        n = min((len(raw) - 16) * 8, end + 64 - at // 8 * 8)
        words = np.ndarray((len(raw) - 3,), "<u4", np.ascontiguousarray(raw), strides=(1,))
        ahead = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel()  # at least 25 bits from each bit on
        last = len(ahead) - 1
        taken = lambda p, bits: ahead[np.minimum(p, last)].astype(np.int64) & ((1 << bits) - 1)  # noqa: B023, E731
        i = ahead[:n] & masks[0]
        symbol, after = green[0][i], np.arange(n, dtype=np.int32) + green[1][i]
        next_ = after.copy()
        reads = []
        for k, (values, lengths) in enumerate((red, blue, alpha), 1):
            if only[k] is None:
                i = ahead[np.minimum(next_, last)] & masks[k]
                reads.append(values[i])
                next_ = next_ + lengths[i]
            else:
                reads.append(only[k])
        jump = np.flatnonzero(symbol >= 256)
        prefix = symbol[jump] - 256
        p = after[jump]
        size = FROM[prefix] + taken(p, EXTRA[prefix])
        p = p + EXTRA[prefix]
        i = taken(p, codes[4].bits)
        code, p = far[0][i], p + far[1][i]
        back = FROM[code] + taken(p, EXTRA[code])
        next_[jump] = p + EXTRA[code]
        one = np.arange(n + 128, dtype=np.int32)  # what lies behind the window stays where it is
        one[:n] = next_
        two = one[one]
        follow, walk, p = memoryview(two[two]), [], at % 8  # four tokens a step
        for _ in range(left // 4 + 1):
            if p >= n:
                break
            walk.append(p)
            p = follow[p]
        walk = np.array(walk)
        walk = np.stack([walk, one[walk], two[walk], one[two[walk]]], axis=1).ravel()
        walk = walk[walk < n]
        p = int(one[walk[-1]])
        copy = symbol[walk] >= 256
        which = np.searchsorted(jump, walk[copy])
        sizes, backs = np.ones(len(walk), np.int64), np.zeros(len(walk), np.int64)
        sizes[copy], backs[copy] = size[which], back[which]
        ends = np.cumsum(sizes)
        read = int(np.searchsorted(ends, left)) + 1
        if read <= len(ends):
            p = int(one[walk[read - 1]])
            walk, sizes, backs, copy, ends = walk[:read], sizes[:read], backs[:read], copy[:read], ends[:read]
        pick = lambda x: x[walk].astype(np.uint32) if isinstance(x, np.ndarray) else np.uint32(x)  # noqa: B023, E731
        argb = pick(reads[2]) << np.uint32(24) | pick(reads[0]) << np.uint32(16) | symbol[walk].astype(np.uint32) << np.uint32(8) | pick(reads[1])
        parts.append((argb, sizes, backs, copy))
        left -= int(ends[-1])
        at = at // 8 * 8 + p
    if left < 0:
        raise ValueError("a copy reaches out of the image")
    argb, sizes, back, copy = (np.concatenate(x) for x in zip(*parts))
    starts = np.cumsum(sizes) - sizes
    near = np.flatnonzero(copy & (back <= len(NEAR)))
    shift = _NEAR[back[near] - 1]
    back = back - len(NEAR)
    back[near] = np.maximum(1, shift[:, 0] + shift[:, 1] * width)
    value = np.zeros(total, np.uint32)
    value[starts[~copy]] = argb[~copy]
    if copy.any():
        k = sizes[copy]
        to = np.repeat(starts[copy] - np.cumsum(k) + k, k) + np.arange(k.sum())
        source = np.arange(total)
        source[to] = to - np.repeat(back[copy], k)
        if source.min() < 0:
            raise ValueError("a copy reaches out of the image")
        while len(to):
            source[to] = source[source[to]]
            to = to[source[source[to]] != source[to]]
        value = value[source]
    r.seek(at)
    return value


def unpredict(px: np.ndarray, modes: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """Adds to each pixel what its block's mode predicts from its decoded neighbours."""
    channels = lambda v: (v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255)
    half = lambda p, q: tuple((x + y) >> 1 for x, y in zip(p, q))
    clamp = lambda x: 0 if x < 0 else min(x, 255)
    if len(modes) and (modes >> 8 & 15 == 1).all():  # left neighbours alone: running sums
        grid = px.astype("<u4").view(np.uint8).reshape(height, width, 4).copy()
        grid[0, 0, 3] = int(grid[0, 0, 3]) + 255 & 255
        grid[:, 0] = np.cumsum(grid[:, 0], axis=0, dtype=np.uint8)
        return np.cumsum(grid, axis=1, dtype=np.uint8).view("<u4").ravel()
    out = [channels(int(v)) for v in px]

    def select(left, top, corner):
        p = [a + b - c for a, b, c in zip(left, top, corner)]
        return left if sum(abs(x - y) for x, y in zip(p, left)) < sum(abs(x - y) for x, y in zip(p, top)) else top

    def predicted(mode, left, top, corner, right):
        match mode:
            case 1:
                return left
            case 2:
                return top
            case 3:
                return right
            case 4:
                return corner
            case 5:
                return half(half(left, right), top)
            case 6:
                return half(left, corner)
            case 7:
                return half(left, top)
            case 8:
                return half(corner, top)
            case 9:
                return half(top, right)
            case 10:
                return half(half(left, corner), half(top, right))
            case 11:
                return select(left, top, corner)
            case 12:
                return tuple(clamp(a + b - c) for a, b, c in zip(left, top, corner))
            case 13:
                mid = half(left, top)
                return tuple(clamp(m + int((m - c) / 2)) for m, c in zip(mid, corner))
        return (255, 0, 0, 0)

    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                p = out[i - 1] if x else (255, 0, 0, 0)
            elif not x:
                p = out[i - width]
            else:
                p = predicted(int(modes[y >> bits, x >> bits]) >> 8 & 15, out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
            out[i] = tuple((a + b) & 255 for a, b in zip(out[i], p))
    flat = np.array(out, dtype=np.uint32).reshape(-1, 4)
    return flat[:, 0] << 24 | flat[:, 1] << 16 | flat[:, 2] << 8 | flat[:, 3]


def uncross(px: np.ndarray, factors: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """Adds back to red and blue what was taken as multiples of green and red."""
    y, x = np.divmod(np.arange(width * height), width)
    f = factors[y >> bits, x >> bits]
    as_signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    delta = lambda t, c: (as_signed(t) * as_signed(c)) >> 5
    green, red, blue = px >> 8 & 255, px >> 16 & 255, px & 255
    red = (red.astype(np.int32) + delta(f, green)) & 255
    blue = (blue.astype(np.int32) + delta(f >> 8, green) + delta(f >> 16, red.astype(np.uint32))) & 255
    return px & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def add_green(px: np.ndarray) -> np.ndarray:
    green = px >> 8 & 255
    return px & np.uint32(0xFF00FF00) | ((px >> 16) + green & 255) << 16 | (px + green) & 255


def unpalette(px: np.ndarray, palette: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """Colours by index; small palettes pack several indices in a pixel's green."""
    packed = -(-width // (1 << bits))
    green = (px >> 8 & 255).reshape(height, packed)
    each = 8 >> bits
    index = np.stack([green >> (each * k) & ((1 << each) - 1) for k in range(1 << bits)], axis=2).reshape(height, -1)[:, :width].ravel()
    known = np.zeros(256, dtype=np.uint32)
    known[: len(palette)] = palette
    return known[index]


def decode(media: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file as an array (height, width, 4) of A, R, G, B samples.

    Simple files and VP8L chunks of extended files are read; ValueError for anything else or for damage.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while media[at : at + 4] != b"VP8L":
        if at + 8 > len(media):
            raise ValueError("no lossless image")
        at += 8 + (n := int.from_bytes(media[at + 4 : at + 8], "little")) + n % 2
    size = int.from_bytes(media[at + 4 : at + 8], "little")
    chunk = media[at + 8 : at + 8 + size]
    if len(chunk) != size or not chunk or chunk[0] != SIGNATURE:
        raise ValueError("the image is cut off or has no signature")
    r = Reader(chunk)
    r.bits(8)
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    undo, coded = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (0, 1):
            bits = r.bits(3) + 2
            wide = -(-coded // (1 << bits))
            blocks = read_pixels(r, wide, -(-height // (1 << bits)), False).reshape(-1, wide)
            undo.append((unpredict if kind == 0 else uncross, (blocks, bits, coded, height)))
        elif kind == 2:
            undo.append((add_green, ()))
        else:
            n = r.bits(8) + 1
            steps = read_pixels(r, n, 1, False).astype("<u4").view(np.uint8).reshape(-1, 4)
            palette = np.cumsum(steps, axis=0, dtype=np.uint8).view("<u4").ravel()
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((unpalette, (palette, bits, coded, height)))
            coded = -(-coded // (1 << bits))
    px = read_pixels(r, coded, height, True)
    for f, args in reversed(undo):
        px = f(px, *args)
    return px.astype(">u4").view(np.uint8).reshape(height, width, 4)


# --- operators --------------------------------------------------------------------------------------

_MEDIA = "doc_id long, n_bytes long, payload_bytes long, media binary"
_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(samples: np.ndarray) -> str:
    """64 bits of the image's coarse brightness: whether each of 64 equal runs of samples is above their mean."""
    runs = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    return np.packbits(runs * 64 > runs.sum()).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as media: (doc_id, n_bytes, payload_bytes, media).

    The UTF-8 bytes of a text, or none for a null, are padded with zeros to a positive multiple of 64. Long
    texts make wider images, up to the format's 16384 x 16384 pixels, a sample each; more is an error. Equal texts give equal media; repeated rows
    and null ids stay; other columns are left out; an empty table gives an empty one.
    """

    def task(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            sizes = np.diff(offsets)
            padded = np.maximum(1, -(-sizes // 64)) * 64
            media = []
            for i, n in enumerate(sizes):
                payload = np.zeros(padded[i], np.uint8)
                payload[:n] = data[offsets[i] : offsets[i + 1]]
                media.append(encode(payload))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(padded, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, _MEDIA)


def load(media: DataFrame, samples: bool = False) -> DataFrame:
    """Decodes media and describes the payload that was read back; with samples, also gives the pixel array of the payload."""

    def task(batches):
        for batch in batches:
            out = []
            for raw, size in zip(batch.column("media").to_pylist(), batch.column("payload_bytes").to_pylist()):
                pixels = decode(raw)[:, :, 2].ravel()[:size]  # the green samples
                data = pixels.tobytes()
                row = [hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(pixels)]
                out.append(row + [data] * samples)
            columns = list(zip(*out)) if out else [()] * (5 + samples)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * samples
            names = ["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["samples"] * samples
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_bytes", "payload_bytes")] + [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_bytes", "payload_bytes", *names])

    return media.mapInArrow(task, _READ + ", samples binary" * samples)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(store(table(spark, sf_dir, "documents")))
