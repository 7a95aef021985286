"""Each corpus operator against brute force or a round trip, with nulls, empty and long texts, ties, repeats and no rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge.llm import ann, common, jaccard, katz, langid, mixing, pieces, secrets, toxicity, warc, webp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, rows, parts=3):
    """Rows (doc_id, text, lang, source) as documents with two more columns whose names clash with results."""
    full = [(i, t, lang, src, len(t or ""), -1, -1.0) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def prose(rng, n, vocab=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocab}" for _ in range(n))


def corpus(seed=1, n=120):
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = prose(rng, rng.choice([1, 3, 5, 30, 80]))
        if i % 7 == 3 and rows:
            t = rows[rng.randrange(len(rows))][1]
        elif i % 7 == 4 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[rng.randrange(len(w))] = "CHANGED"
            t = " ".join(w)
        rows.append((i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None])))
    return [*rows, (1, None, None, None), (2, "", "en", "a"), (4, " \t\n ", "en", "a"), (5, "é " * 3000, "en", "b"), rows[0], rows[0]]


# --- shared helpers ---------------------------------------------------------------------------------


def test_word_hashes_equal_words_equal_hashes():
    texts = ["Ab  c\td", None, "", "ab é É\nC", "x" * 5000]
    data, offsets = common.text_buffers(pa.array(texts))
    h, n = common.word_hashes(data, offsets)
    words = [w for t in texts for w in WORD.findall(low(t))]
    assert n.tolist() == [len(WORD.findall(t or "")) for t in texts] and len(h) == len(words)
    assert len(set(h.tolist())) == len(set(words)) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


# --- 1 toxicity -------------------------------------------------------------------------------------


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(0)
    vocab = np.arange(300, dtype=np.uint64)
    rows = sorted({(int(d), int(t)) for d, t in zip(rng.integers(0, 200, 9000), (rng.pareto(0.6, 9000) * 3).astype(int) % 300)})
    doc, term = (np.array(x) for x in zip(*rows))
    n, w = rng.integers(1, 4, len(doc)), 0.1 + rng.random(300)
    index = toxicity.Index((doc, term, n), vocab, w, np.arange(200) % 2, np.arange(200))
    dense = np.zeros((200, 300))
    dense[doc, term] = (1 + np.log(n)) * w[term]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for _ in range(40):
        own = np.unique(rng.integers(0, 300, rng.integers(1, 60)))
        m = rng.integers(1, 4, len(own))
        q = np.zeros(300)
        q[own] = (1 + np.log(m)) * w[own]
        want = np.sort(dense @ (q / np.linalg.norm(q)))[::-1][: toxicity.NEAREST]
        _, got = index.nearest(own, m)
        assert np.allclose(got, want[want > 1e-9], atol=1e-6)


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40) + (" vile foul" if i % 4 == 0 else ""), None, None) for i in range(400)]
    extra = [(1000, None, None, None), (1001, "", None, None), rows[0]]
    d = docs(spark, rows + extra)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.fit(labels, d)).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if 300 <= r["doc_id"] < 400]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    none = toxicity.fit(labels.limit(0), d)
    assert {r["score"] for r in toxicity.score(d, none).collect()} == {0.0} and toxicity.score(d.limit(0), none).count() == 0


def test_toxicity_cosines_count_unseen_and_single_terms(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "GAIN", 0.0)
    rng = random.Random(8)
    letters = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    common = [letters() for _ in range(30)]
    rows = [(i, " ".join([*rng.choices(common, k=12), letters(), "vile foul" if i % 3 == 0 else "kind"]), None, None) for i in range(60)]
    rows.append((100, "vile foul " + " ".join(letters() for _ in range(300)), None, None))
    rows.append((101, rows[5][1] + " " + letters(), None, None))
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["evidence"] for r in toxicity.score(d, toxicity.fit(labels, d)).collect()}
    count = {i: collections.Counter(t.split()) for i, t, *_ in rows}
    df = collections.Counter(w for c in count.values() for w in c)
    vector = {i: {w: (1 + math.log(n)) * math.log((len(rows) + 1) / (df[w] + 1)) for w, n in c.items()} for i, c in count.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}
    for i in (100, 101, 7):
        assert got[i]
        for e in got[i]:
            j = e["doc_id"]
            cosine = sum(x * vector[j].get(w, 0) for w, x in vector[i].items()) / norm[i] / norm[j]
            assert abs(cosine - e["cosine"]) < 1e-5


# --- 2 pieces ---------------------------------------------------------------------------------------


def test_pieces_without_dropout_are_the_models_own():
    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load_model()
    e = pieces.Encoder(m, 0, 0.0, 1)
    for t in ["The cat  sat\nthere", "  ", " x ", "日本語 héllo😀 \t tab", "x" * 300, "ab " * 50, "Supercalifragilistic-expialidocious!!", "\n\n a"]:
        chunks = pieces.CHUNK.findall(" " + t)
        found = pieces.Both(e.look_up(set(chunks)), e.known)
        assert np.frombuffer(b"".join(found[c] for c in chunks), "<i4").tolist() == sp.encode(t)


@pytest.mark.parametrize("dropout", [0.1, 0.6])
def test_pieces_rounds_equal_the_agenda(dropout):
    e = pieces.Encoder(pieces.load_model(), 1, dropout, 5)
    words = [" internationalisation", " the", "  deux", "aaaaaaaa", " über", " x", "…", " wordword" * 3]
    words = [w for w in words if len(w) <= pieces.SCANNED]
    for w, raw in zip(words, e.encode_all(words)):
        symbols = [pieces.SPACE if c == " " else c for c in w]
        base = zlib.crc32(w.encode(), e.key)
        assert e.scan(list(symbols), base) == e.agenda(list(symbols), base)
        if raw is not None:
            assert np.frombuffer(raw, "<i4").tolist() == e.encode(w)


def test_pieces_round_trip(spark):
    texts = [None, "", " ", "▁a ▁", "\0 a\0", "<s> <0x41> </s>", " " * 70 + "z", "a▁b" * 60, "y" * 3000, "été\tou\n" * 50]
    d = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(0, "again", None, None)])
    ids = pieces.encode(d, dropout=0.3)
    got = pieces.decode(ids).collect()
    assert len(got) == len(texts) + 1 and all(r["decoded"] == r["text"] for r in got)
    assert sorted(map(str, ids.select("doc_id", "ids").collect())) == sorted(map(str, pieces.encode(d, dropout=0.3).select("doc_id", "ids").collect()))
    assert sorted(map(str, ids.select("ids").collect())) != sorted(map(str, pieces.encode(d, dropout=0.3, seed=99).select("ids").collect()))
    assert pieces.decode(pieces.encode(d.limit(0))).count() == 0


@pytest.mark.parametrize("dropout", [0.1, 0.6])
def test_pieces_runs_equal_a_scan_of_each_occurrence(dropout):
    rng = np.random.default_rng(7)
    words = [" the", " internationalisation", " x", "\n", "  deux", " über", " \U0001f600a", "z" * 90, " wordword", "aaaaaaaa"] * 60
    for remembered in (5, 10**6):
        e = pieces.Encoder(pieces.load_model(), 0, dropout, 5, remembered)
        for _ in range(2):
            bases = rng.integers(0, 1 << 32, len(words), dtype=np.uint32)
            ids, counts = e.segments(words, bases)
            ends = np.cumsum(counts)
            assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends)] == [e.encode(w, int(b)) for w, b in zip(words, bases)]


def test_pieces_segment_each_occurrence_for_itself(spark):
    word = "internationalisation"
    d = docs(spark, [(i, " ".join([word] * 50), None, None) for i in range(4)])
    got = [tuple(r["ids"]) for r in pieces.encode(d, dropout=0.3).collect()]
    assert len(set(got)) == 4
    texts = pieces.load_model()["texts"]
    split = "|".join(texts[i].decode() for i in got[0]).split("| ")
    assert len(set(split)) > 2


# --- 3 media ----------------------------------------------------------------------------------------


class Writer:
    """A small encoder of all that the decoder must undo; only for tests."""

    def __init__(self, width, height):
        self.b = webp.Bits().put(webp.SIGNATURE, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)

    def code(self, lengths):
        """A prefix code by explicit lengths, all of them written with a flat code-length code."""
        self.b.put(0, 1).put(15, 4)
        for s in webp.CODE_LENGTH_ORDER:
            self.b.put(4 if s < 16 else 0, 3)
        self.b.put(0, 1)
        flat = webp.REVERSED[4]
        for n in lengths:
            self.b.put(int(flat[n]), 4)
        codes, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            codes[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
            code, last = code + 1, n
        return codes if len(codes) > 1 else {s: (0, 0) for s in codes}

    def put(self, codes, s):
        self.b.put(*codes[s])

    def pixels(self, px, main, symbols=None, cache=0):
        """px as literals, or symbols: ('lit', argb), ('copy', length prefix, distance prefix, extras), ('cache', i)."""
        self.b.put(int(cache > 0), 1)
        if cache:
            self.b.put(cache, 4)
        if main:
            self.b.put(0, 1)
        symbols = symbols or [("lit", int(p)) for p in px]
        uses = [collections.Counter() for _ in range(5)]
        for s in symbols:
            if s[0] == "lit":
                for k, shift in enumerate((8, 16, 0, 24)):
                    uses[k][s[1] >> shift & 255] += 1
            elif s[0] == "copy":
                uses[0][256 + s[1]] += 1
                uses[4][s[2]] += 1
            else:
                uses[0][280 + s[1]] += 1
        codes = []
        for k, size in enumerate((280 + (1 << cache if cache else 0), 256, 256, 256, 40)):
            used = sorted(uses[k]) or [0]
            lengths = [0] * size
            # a complete code of unequal lengths: 1, 2, 3, ... and the last two alike; flat when there are many
            if len(used) <= 12:
                for i, s in enumerate(used):
                    lengths[s] = max(1, min(i + 1, len(used) - 1))
            else:
                n = (len(used) - 1).bit_length()
                short = (1 << n) - len(used)
                for i, s in enumerate(used):
                    lengths[s] = n - 1 if i < short else n
            codes.append(self.code(lengths))
        for s in symbols:
            if s[0] == "lit":
                for k, shift in enumerate((8, 16, 0, 24)):
                    self.put(codes[k], s[1] >> shift & 255)
            elif s[0] == "copy":
                self.put(codes[0], 256 + s[1])
                self.b.put(*s[3][0])
                self.put(codes[4], s[2])
                self.b.put(*s[3][1])
            else:
                self.put(codes[0], 280 + s[1])

    def file(self):
        chunk = self.b.value.to_bytes(self.b.n // 8 + 1, "little")
        chunk += b"\0" * (len(chunk) % 2)
        return b"RIFF" + (12 + len(chunk)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk


def argb(samples):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for a, r, g, b in samples.reshape(-1, 4)]


def test_webp_literals_copies_and_cache():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 40, (6, 4), dtype=np.uint8)
    px = argb(base)
    w = Writer(4, 4)
    w.b.put(0, 1)
    # 6 literals, 4 copied from 6 back (code 126), 3 from the pixel above (code 1), 3 from the cache
    stream = [("lit", p) for p in px] + [("copy", 3, 13, ((0, 0), (126 - 97, 5)))]
    full = px + px[:4]
    stream.append(("copy", 2, 0, ((0, 0), (0, 0))))
    full += full[-4:-1]
    for p in (px[0], px[3], px[5]):
        stream.append(("cache", (0x1E35A7BD * p & 0xFFFFFFFF) >> 29))
    table = {}
    for p in full:
        table[(0x1E35A7BD * p & 0xFFFFFFFF) >> 29] = p
    w.pixels(None, True, stream, cache=3)
    for p in (px[0], px[3], px[5]):
        full.append(table[(0x1E35A7BD * p & 0xFFFFFFFF) >> 29])
    assert argb(webp.decode(w.file())) == full


def predictions(px, modes, bits, width, height):
    """Residuals: the inverse of the inverse, found by decoding with each pixel's own value known."""
    out = px.copy()
    zero = np.zeros_like(px)
    for i in range(len(px)):
        trial = out.copy()
        trial[i:] = zero[i:]
        got = webp.unpredict(trial.astype(np.uint32), modes, bits, width, height)
        out[i] = sum((((int(px[i]) >> s & 255) - (int(got[i]) >> s & 255)) & 255) << s for s in (0, 8, 16, 24))
    return out


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    rng = np.random.default_rng(mode)
    width, height = 5, 4
    px = rng.integers(0, 1 << 32, width * height, dtype=np.uint32)
    modes = np.full((1, 2), mode << 8, dtype=np.uint32)
    residual = predictions(px, modes, 2, width, height)
    w = Writer(width, height)
    w.b.put(1, 1).put(0, 2).put(0, 3)
    w.pixels(modes.ravel(), False)
    w.b.put(0, 1)
    w.pixels(residual, True)
    assert argb(webp.decode(w.file())) == px.tolist()


def test_webp_known_predictions():
    left, top, corner, right = 0x01020304, 0x05060708, 0x01010101, 0x09090909
    want = {1: left, 2: top, 3: right, 4: corner, 7: 0x03040506, 11: top, 12: 0x0507090B, 13: 0x04050708}
    for mode, value in want.items():
        residual = np.array([0, 0, 0, 0, 0, 0], dtype=np.uint32)
        sub = lambda a, b: sum((((a >> s & 255) - (b >> s & 255)) & 255) << s for s in (0, 8, 16, 24))
        residual[0], residual[1], residual[2], residual[3] = sub(corner, 0xFF000000), sub(top, corner), sub(right, top), sub(left, corner)
        got = webp.unpredict(residual, np.full((1, 1), mode << 8, np.uint32), 2, 3, 2)
        assert (mode, hex(int(got[4]))) == (mode, hex(value))


def test_webp_colour_transforms():
    rng = np.random.default_rng(9)
    px = rng.integers(0, 1 << 32, 12, dtype=np.uint32)
    factors = np.array([[0xFF00C85A & 0xFFFFFFFF | 0x37 << 16]], dtype=np.uint32)
    signed = lambda x: (int(x) & 255) - 256 if int(x) & 128 else int(x) & 255
    coded = []
    for p in map(int, px):
        a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        f = int(factors[0, 0])
        b2 = (b - (signed(f >> 8) * signed(g) >> 5) - (signed(f >> 16) * signed(r) >> 5)) & 255
        r2 = (r - (signed(f) * signed(g) >> 5)) & 255
        coded.append(a << 24 | (r2 - g & 255) << 16 | g << 8 | (b2 - g & 255))
    w = Writer(4, 3)
    w.b.put(1, 1).put(1, 2).put(0, 3)
    w.pixels(factors.ravel(), False)
    w.b.put(1, 1).put(2, 2).put(0, 1)
    w.pixels(coded, True)
    assert argb(webp.decode(w.file())) == px.tolist()


@pytest.mark.parametrize("colours", [2, 4, 9, 40])
def test_webp_palette(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    index = rng.integers(0, colours, 7 * 3)
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, each = 1 << bits, 8 >> bits
    packed = []
    for row in index.reshape(3, 7):
        for i in range(0, 7, per):
            packed.append(0xFF000000 | sum(int(v) << each * k for k, v in enumerate(row[i : i + per])) << 8)
    steps = [int(palette[0])] + [sum((((int(b) >> s & 255) - (int(a) >> s & 255)) & 255) << s for s in (0, 8, 16, 24)) for a, b in zip(palette, palette[1:])]
    w = Writer(7, 3)
    w.b.put(1, 1).put(3, 2).put(colours - 1, 8)
    w.pixels(steps, False)
    w.b.put(0, 1)
    w.pixels(packed, True)
    assert argb(webp.decode(w.file())) == palette[index].tolist()


def test_webp_damage_is_told():
    good = webp.encode(np.arange(128, dtype=np.uint8))
    for bad in (good[:20], b"RIFX" + good[4:], good[:8] + b"WEBX" + good[12:], good[:-30]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_webp_writer_uses_the_format(monkeypatch):
    rng = np.random.default_rng(2)
    prose = " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "über", "and", "again"], 900)).encode()
    prose += prose[:700]
    prose += b"\0" * (-len(prose) % 64)
    cases = {"codes": np.frombuffer(prose, np.uint8), "palette": rng.integers(0, 5, 640).astype(np.uint8) + 60, "two": rng.integers(0, 2, 192).astype(np.uint8), "one": np.zeros(64, np.uint8), "left": np.cumsum(rng.integers(0, 3, 6400)).astype(np.uint8), "noise": rng.integers(0, 256, 12800, dtype=np.uint8)}
    seen = collections.Counter()
    for name in ("unpredict", "unpalette"):
        def counted(*args, real=getattr(webp, name), name=name):
            seen[name] += 1
            return real(*args)
        monkeypatch.setattr(webp, name, counted)
    sizes = {}
    for at_once in (1 << 20, 1024):
        monkeypatch.setattr(webp, "AT_ONCE", at_once)
        for name, payload in cases.items():
            media = webp.encode(payload)
            sizes[name] = len(media) / len(payload)
            assert (webp.decode(media)[:, :, 2].ravel()[: len(payload)] == payload).all(), name
            assert (webp.decode(media)[:, :, 0] == 255).all()
    assert sizes["codes"] < 0.4 and sizes["palette"] < 0.5 and sizes["left"] < 0.35 and sizes["noise"] < 1.1
    assert seen["unpredict"] == 4 and seen["unpalette"] == 12 and len(webp.copies(cases["codes"])) > 20
    with pytest.raises(ValueError, match="does not fit"):
        webp.encode(np.broadcast_to(np.uint8(0), webp.SIDE**2 + 64))


def test_webp_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = (rng.pareto(0.4, 60) * rng.integers(0, 3, 60)).astype(int).tolist()
        n = [x for x in webp.code_lengths(counts, 12) if x]
        assert sum(2.0**-x for x in n) == (1.0 if n else 0.0) and max(n, default=0) <= 12
    fib = [1, 1, 2, 3, 5, 8, 13]
    assert sorted(webp.code_lengths(fib, 12)) == [1, 2, 3, 4, 5, 6, 6]


def test_media_round_trip(spark):
    rows = [(1, "Abc é" * 50, None, None), (2, None, None, None), (3, "", None, None), (4, "x", None, None), (5, "long " * 400_000, None, None), (6, "Abc é" * 50, None, None), (1, "Abc é" * 50, None, None)]
    got = webp.load(webp.store(docs(spark, rows)), samples=True).collect()
    assert len(got) == len(rows)
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    for r in got:
        raw = texts[r["doc_id"]]
        padded = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert bytes(r["samples"]) == padded and r["n_bytes"] == len(raw) and r["payload_bytes"] == len(padded)
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (1, 6)}) == 1
    assert webp.load(webp.store(docs(spark, rows).limit(0))).count() == 0


# --- 4 language model -------------------------------------------------------------------------------


def katz_by_hand(tokens, held):
    """(words, unknown, chance): the trigram model written down as its definition, over lists of tokens that end in None."""
    one, two, three = (collections.Counter() for _ in range(3))
    for i, w in tokens:
        if i not in held:
            one.update(w)
            two.update(zip([None, *w[:-1]], w))
            three.update(zip([None, *w[:-2]], w[:-1], w[1:]))
    counts = lambda c: [0] + [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    d1, d2, d3 = (katz.discounts(counts(c)) for c in (one, two, three))
    cut = lambda c, d: d[c] * c if c <= katz.K else c - katz.K * (1 - d[katz.K])
    n = sum(one.values())
    p = {w: cut(c, d1) / n for w, c in one.items()}
    unknown = 1 - sum(p.values())
    follow, after = collections.defaultdict(dict), collections.defaultdict(dict)
    for (u, w), c in two.items():
        follow[u][w] = cut(c, d2) / one[u]
    for (t, u, w), c in three.items():
        after[t, u][w] = cut(c, d3) / two[t, u]
    alpha = {u: (1 - sum(x.values())) / (1 - sum(p[w] for w in x)) for u, x in follow.items()}
    alpha2 = {(t, u): (1 - sum(x.values())) / (1 - sum(follow[u][w] for w in x)) for (t, u), x in after.items()}

    def chance(w, u, *t):
        """Of w after u, and after t and u where t is given."""
        if t:
            own = after.get((*t, u), {})
            return own[w] if w in own else alpha2.get((*t, u), 1) * chance(w, u)
        own = follow.get(u, {})
        return own[w] if w in own else alpha.get(u, 1) * p.get(w, unknown)

    for u in list(follow)[:40]:  # exactly normalised over the vocabulary and the unknown token, whatever stands before
        assert sum(chance(w, u) for w in [*one, "unknown"]) == pytest.approx(1)
    for t, u in list(after)[:40]:
        assert sum(chance(w, u, t) for w in [*one, "unknown"]) == pytest.approx(1)
    return one, three, chance


@pytest.mark.parametrize("chunk", [8 << 20, 1 << 10])
def test_katz_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(katz, "CHUNK_BYTES", chunk)
    rows = corpus(5)
    held = {i for i, *_ in rows if i % 4 == 0}
    got = katz.score(docs(spark, rows), F.col("doc_id") % 4 == 0).collect()
    assert len(got) == len(rows)
    tokens = [(i, [*WORD.findall(low(t)), None]) for i, t, *_ in rows]
    one, three, chance = katz_by_hand(tokens, held)
    assert {c for c in three.values() if c > katz.K} and {c for c in three.values() if c == 1}
    n, v = sum(one.values()), len(one)
    want, orders = collections.Counter(), collections.Counter()
    for i, w in tokens:
        before = [None, *w[:-1]]
        s = math.log10(chance(w[0], None)) + sum(math.log10(chance(x, u, t)) for t, u, x in zip(before, before[1:], w[1:]))
        orders.update((t, u, x) in three for t, u, x in zip(before, before[1:], w[1:]))
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i, i in held, len(w), sum(x in one for x in w), n, round(base, 6), round(s, 6)] += 1
    assert min(orders[True], orders[False]) > 100
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_katz_of_nothing(spark):
    d = docs(spark, [(1, "a b", None, None), (2, None, None, None)])
    assert {(r["score"], r["base_score"], r["n_known"]) for r in katz.score(d, F.lit(True)).collect()} == {(0.0, 0.0, 0)}
    assert katz.score(d.limit(0), F.lit(True)).count() == 0


# --- 5 WARC -----------------------------------------------------------------------------------------


def pages(spark):
    same = "<p>" + "x" * 200 + "</p>"
    rows = [(9, "http://a/ b", same), (3, "http://a/2", same), (4, None, "short"), (5, "http://a/4", "short"), (6, "http://a/é", None), (7, "u", ""), (8, "u", "é" * 60), (3, "http://a/2", same), (None, "u", "null id" * 30)]
    return spark.createDataFrame([(*r, "response") for r in rows], "page_id long, url string, html string, record_type string").repartition(2), rows


def test_warc_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    got = warc.pages_of(warc.read(warc.write(df, str(tmp_path)), payload=False)).collect()
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        raw = html[r["page_id"]]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if r["page_id"] == 9 else ("response", None))
    assert warc.pages_of(warc.read(warc.write(df.limit(0), str(tmp_path / "none")))).count() == 0


def test_warc_revisits_of_an_id_with_two_payloads(spark, tmp_path):
    a, b = "a" * 150, "b" * 190
    rows = [(1, "u", a), (1, "u", b), (2, "u", a), (3, "u", b)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.pages_of(warc.read(warc.write(df, str(tmp_path)), payload=False)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 150, sha(a), "response", None), (1, 190, sha(b), "response", None), (2, 150, sha(a), "revisit", 1), (3, 190, sha(b), "revisit", 1)]
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want)


@pytest.mark.parametrize("gzipped", [True, False])
def test_warc_salvage(tmp_path, gzipped):
    parts = [warc.record(i, f"http://x/{i}", (f"payload {i} " * 50).encode(), hashlib.sha256((f"payload {i} " * 50).encode()).hexdigest(), None) for i in range(6)]
    parts = [warc.member(p) if gzipped else p for p in parts]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + parts[1] + bytes(broken) + b"garbage\x1f\x8b\x08WARC/1.0" * 3 + b"\r\n" + parts[3] + parts[4] + parts[5][: len(parts[5]) // 2]
    path = tmp_path / "a.warc"
    path.write_bytes(data)
    with open(path, "rb") as f:
        found = list(warc.salvage(f, gzipped))
    good = [x["page_id"] for x in found if "reason" not in x]
    gaps = [(x["start"], x["gap_end"]) for x in found if "reason" in x]
    assert good == [0, 1, 3, 4]
    begin = len(parts[0]) + len(parts[1])
    lost = {b for a, e in gaps for b in range(a, e)}
    later = data.index(parts[3])
    assert lost == {*range(begin, later), *range(later + len(parts[3]) + len(parts[4]), len(data))}


@pytest.mark.parametrize("bad", ["record", "member"])
def test_warc_salvages_records_of_one_member(tmp_path, bad):
    payload = lambda i: random.Random(i).randbytes(3000)
    parts = [warc.record(i, f"http://x/{i}", payload(i), hashlib.sha256(payload(i)).hexdigest(), None) for i in range(3)]
    if bad == "record":
        parts[1] = parts[1].replace(payload(1)[:8], b"damaged!")
    data = bytearray(warc.member(b"".join(parts)))
    if bad == "member":
        data[len(data) // 2] ^= 0xFF
    path = tmp_path / "a.warc.gz"
    path.write_bytes(bytes(data) + warc.member(warc.record(9, "u", b"last", hashlib.sha256(b"last").hexdigest(), None)))
    with open(path, "rb") as f:
        found = list(warc.salvage(f, True))
    assert [x["page_id"] for x in found if "reason" not in x] == ([0, 2, 9] if bad == "record" else [0, 9])
    assert sum("reason" in x for x in found) == 1


def test_warc_tells_of_missing_records(spark, tmp_path):
    df, _ = pages(spark)
    manifest = warc.write(df, str(tmp_path))
    path = manifest.first()["path"]
    with open(path, "r+b") as f:
        f.seek(20)
        f.write(b"\xff" * 40)
    with pytest.raises(RuntimeError, match="gaps"):
        warc.pages_of(warc.read(manifest, payload=False), manifest)


# --- 6 Jaccard join ---------------------------------------------------------------------------------


def brute_components(rows, num=85, den=100):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(low(t))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    near = {i: i for i in sets}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    near[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(rng, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"n{rng.randrange(99)}"], [w[k], "and"]])
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_equals_brute_force(spark, seed):
    rng, rows = random.Random(seed), corpus(seed, 60)
    for size in (4, 6, 8, 10, 13, 20, 40, 90, 300):
        base = " ".join(f"v{rng.randrange(10_000)}" for _ in range(size))
        rows += [(rng.randrange(10**9), edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.04])), None, None) for _ in range(9)]
        rows += [(rng.randrange(10**9), base + f" tail{k}" * (k % 3), None, None) for k in range(4)]
    got = jaccard.components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, *want[i]) for i in want}


@pytest.mark.parametrize("share", [0.012, 0.03, 0.06])
def test_jaccard_large_groups_near_the_threshold(spark, monkeypatch, share):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "PAIRS", 7)
    rng = random.Random(8)
    rows = []
    for size in (40, 120):
        base = " ".join(f"v{rng.randrange(10_000)}" for _ in range(size))
        rows += [(len(rows) + k, edited(rng, base, share), None, None) for k in range(60)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.components(docs(spark, rows)).collect()}
    assert got == {(i, c) for i, (_, c) in brute_components(rows).items()}


def test_jaccard_sketches_bound_differences():
    rng = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 5000):
        a = rng.integers(1, 1 << 60, n).astype(np.uint64)
        for k in (0, 1, n // 7, n):
            b = np.concatenate([a[k:], rng.integers(1, 1 << 60, k + 1).astype(np.uint64)])
            x, y = jaccard.folded([jaccard.sketch(a), jaccard.sketch(b)])
            assert int(np.bitwise_count(x ^ y).sum()) <= 2 * k + 1


def test_jaccard_of_nothing(spark):
    assert jaccard.components(docs(spark, corpus()).limit(0)).count() == 0
    odd = jaccard.components(docs(spark, [(None, "a b c d e", None, None), (1, None, None, None), (2, "a b c d e", None, None)])).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in odd} == {(None, 2, None), (1, 0, 1), (2, 2, 2)}


@pytest.mark.parametrize("num", [80, 85])
def test_pigeonhole_holds_for_random_pairs(num):
    plan = jaccard.Plan(num, 100)
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 6, 7, 8, 12, 13, 14, 19, 20, 30, 44, 45, 60, 150, 700):
        for _ in range(30):
            a = rng.integers(1, 1 << 60, size).astype(np.uint64)
            drop, add = rng.integers(0, size // 5 + 1), rng.integers(0, size // 5 + 1)
            b = np.concatenate([a[drop:], rng.integers(1, 1 << 60, add).astype(np.uint64)])
            both, union = size - drop, size + add
            if 100 * both < num * union:
                continue
            found = []
            for x in (a, b):
                n = np.array([len(x)])
                band = plan.band(n)
                out = set()
                for lower in (False, True):
                    if lower and (band[0] == 0 or num * len(x) > 100 * plan.ends[band[0] - 1]):
                        continue
                    sig, _, slack = jaccard.signatures(np.sort(x), n, band - lower, plan, lower)
                    # any ranking that both sets share may say which signatures are left out
                    out |= set(np.sort(common.mix(sig))[int(slack[0]) :].tolist())
                found.append(out)
            assert found[0] & found[1]


# --- 7 mixing ---------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= epochs * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        out |= {s: float(epochs * sizes[s]) for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 40)), None, "hot" if i % 2 else rng.choice(["a", "b", "c", "é", None, "Z"])) for i in range(400)]
    rows += [(1000, None, None, "a"), (1001, " ", None, None), rows[0]]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    words = collections.Counter()
    for _, t, _, s in rows:
        words[s] += len(WORD.findall(t or ""))
    want = brute_targets(words)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) == int(1.5 * sum(words.values()))
    assert all(abs(taken[s] - want[s]) <= 80 for s in want)
    key = lambda rs: sorted((r["doc_id"], r["size"], r["taken"]) for r in rs)
    assert key(mixing.mix(d.repartition(7)).collect()) == key(got)
    assert mixing.mix(d.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(d.filter("doc_id > 999")).collect()} == {0}


@pytest.mark.parametrize("seed", [3, 4])
def test_mixing_takes_by_finish_time(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(0, 60)), None, rng.choice(["a"] * 5 + ["b", "c", None])) for i in range(200)]
    d = docs(spark, rows).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long"))
    queued = d.select("doc_id", "source", "size", F.xxhash64(F.lit(11), "doc_id", "size").alias("h")).filter("size > 0").collect()
    words = collections.Counter()
    for r in queued:
        words[r["source"]] += r["size"]
    want, passes = brute_targets(words), []
    for s in words:
        end = 0
        for r in sorted((r for r in queued if r["source"] == s), key=lambda r: (r["h"], r["doc_id"])):
            end += r["size"]
            passes += [((end + k * words[s]) / want[s], s is None, s or "", r["h"], r["doc_id"], k, r["size"]) for k in range(2)]
    left, taken = int(1.5 * sum(words.values())), collections.Counter()
    for *_, i, _, n in sorted(passes):
        taken[i] += min(n, left)
        left -= min(n, left)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(d).collect() if r["taken"]} == {i: n for i, n in taken.items() if n}


# --- 8 language ID ----------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(3)
    words = {"en": "the quick brown fox jumps over lazy dogs and runs away home", "de": "der schnelle braune fuchs springt über den faulen hund nach hause", "fr": "le renard brun saute par dessus le chien paresseux à la maison"}
    text = lambda lang, n: " ".join(rng.choice(words[lang].split()) for _ in range(n))
    rows = [(i, text(lang, 30), lang, None) for i, lang in enumerate(rng.choices(list(words), k=150))]
    odd = [(900, None, "en", None), (901, "", None, None), (902, "123 !!! 。", None, None), (903, "é", None, None), (904, "a", None, None), (905, text("en", 60) + " " + text("fr", 60), None, None), (906, "дом", None, None), rows[0]]
    d = docs(spark, rows + odd)
    model = langid.learn(d.filter("doc_id % 5 <> 0"))
    got = langid.identify(d, model).collect()
    assert len(got) == len(rows) + len(odd) and model[0] == ["de", "en", "fr"]
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang, _ in rows)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and all(by[i]["lang_pred"] in words for i in (903, 904, 906))
    assert set(by[905]["langs"]) == {"en", "fr"} and 0.3 < by[905]["score"] < 0.7
    assert {r["lang_pred"] for r in langid.identify(d, langid.learn(d.limit(0))).collect()} == {"und"}
    assert langid.identify(d.limit(0), model).count() == 0


def test_mixture_weights_are_likeliest():
    rng = np.random.default_rng(1)
    p = rng.random((50, 3)) ** 6
    p /= p.sum(axis=0)
    x = rng.multinomial(50_000, p @ np.array([0.6, 0.1, 0.3])).astype(float)
    w, ll = langid.fit(p, x, np.full(3, 1 / 3))
    grid = [(a / 20, b / 20) for a in range(21) for b in range(21 - a)]
    assert ll >= max(x @ np.log(p @ np.array([a, b, 1 - a - b]) + 1e-300) for a, b in grid) - 5 and np.allclose(w, [0.6, 0.1, 0.3], atol=0.06)


# --- 9 nearest neighbours ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [30, 900])
def test_ann(spark, n):
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(12, 16))
    v = [(i, [float(x) for x in centre[i % 12] + 0.4 * rng.normal(size=16)], "x") for i in range(n)]
    v += [(n + k, v[0][1], "x") for k in range(8)]
    odd = [(5000, None, "x"), (5050, [0.0] * 16, "x"), (5100, [None] + [1.0] * 15, "x"), (5150, [float("nan")] * 16, "x"), (5200, [1.0], "x"), (5250, [], "x")]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<double>, score string").repartition(3)
    got = ann.search(df, df.filter("vec_id % 10 = 0")).collect()
    x = np.array([e for _, e, _ in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, *_ in v])
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 10 == 0]:
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -np.round(s, 12))) if i != q][:5]
        assert len(found[q]) == 5 and all(abs(sc - s[i]) < 1e-12 for i, sc in found[q]) and q not in dict(found[q])
        hits += len({i for i, _ in found[q]} & set(best))
    assert set(found) == set(ids[ids % 10 == 0].tolist()) and hits >= 0.9 * 5 * len(found)
    assert [i for i, _ in found[0]][:5] == [n + k for k in range(5)]  # ties go to the smaller id
    assert ann.search(df.limit(0), df).count() == 0


def test_ann_takes_one_length_for_vectors_and_queries(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(1, 40)] + [(i, [1.0, 2.0]) for i in (50, 100, 150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.search(df, df.filter("vec_id % 50 = 0")).count() == 0
    assert {r["query_id"] for r in ann.search(df, df.filter("vec_id % 10 = 0")).collect()} == {10, 20, 30}


def test_ann_sends_no_vectors_to_every_executor(spark):
    """Stored queries are small, as their copies compress well, but blocks of them are not."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    assert "Broadcast" not in ann.search(df, df.filter("vec_id % 10 = 0"))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [40, 500])
def test_ann_tiles_find_what_whole_parts_find(spark, monkeypatch, n):
    """Parts of several tiles, repeated vectors and ids among them."""
    rng = np.random.default_rng(n)
    v = [(i, [float(x) for x in rng.integers(-3, 4, size=8)]) for i in range(n)]
    df = spark.createDataFrame([*v, *[(n + i, v[i][1]) for i in range(10)], v[3], v[20]], "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(ann.search(df, df.filter("vec_id % 5 = 0")).collect())
    monkeypatch.setattr(ann, "BLOCK", 7)
    monkeypatch.setattr(ann, "TILE", 7 * 8)
    monkeypatch.setattr(ann, "SCORES", 20)
    assert sorted(ann.search(df, df.filter("vec_id % 5 = 0")).collect()) == whole and len(whole) >= 5 * (n // 5)


# --- 10 secrets -------------------------------------------------------------------------------------


def brute_spans(t):
    out = []
    for m in re.finditer(secrets.ASSIGN, t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def secret_texts():
    rng = random.Random(6)
    key = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(rng.choice(a) for _ in range(n))
    hexa = "0123456789abcdef"
    texts = [None, "", "no secrets here", "😀é token: secret: abcdefgh12 tail", 'PassWord = "hunter2hunter2", api-key=xx apikey: k3y+/=_-.aa', f"x AKIA{key(12, 'ABC123')} AKIAshort {key(31, hexa)} {key(32, hexa)} {key(64, hexa)}", "token=" + key(40, hexa), "secret=" * 5 + "abc", f"see {key(40)} and {key(24)}", "id aaaaaaaaaaaaaaaaaaaa1111111111 abcdefghij0123456789klmnop", "word " * 5000 + key(44), f"\u0001{key(33, hexa)}\u0002", key(30, hexa) + "é" + key(33, hexa)]
    return texts, key


def ordinary_runs(seed, n=400):
    """Texts of long words, paths, identifiers, dates and numbers: what no scan should flag."""
    rng, rows = random.Random(seed), []
    parts = ["tion", "er", "the", "ing", "an", "re", "heit", "ver", "ou", "que", "ment", "ble", "st", "on"]
    word = lambda k: "".join(rng.choice(parts) for _ in range(k))
    for i in range(n):
        path = "/".join([word(1), word(2), str(rng.randrange(2000, 2030)), "-".join(word(1) for _ in range(4))])
        camel = word(2) + "".join(word(1).capitalize() for _ in range(3))
        rows.append((50_000 + i, f"{word(5)} {word(7)} www.{path} {camel} {word(2)}_{word(2)}_{word(1)} {rng.randrange(10**15, 10**16)} 2024-{rng.randrange(10, 13)}-{rng.randrange(10, 29)} {word(6).upper()} {word(4).capitalize()}", None, None))
    return rows


def test_secrets(spark):
    texts, key = secret_texts()
    rows = ordinary_runs(1) + [(i, t, None, None) for i, t in enumerate(texts)] + [(100, texts[5], None, None), (100, texts[5], None, None)]
    got = secrets.scan(docs(spark, rows), text=True).withColumn("m", secrets.masked(F.col("text"), F.col("spans"))).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        assert [tuple(s) for s in r["base"]] == brute_spans(t)
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))
        want, at = "", 0
        for s, _, e in sorted(map(tuple, r["spans"])):
            if s >= at:
                want += t[at:s] + "<secret>"
            at = max(at, e)
        assert r["m"] == (want + t[at:] if r["spans"] else r["text"])
    by = {r["doc_id"]: r for r in got}
    found = lambda i: [by[i]["text"][s["start"] : s["end"]] for s in by[i]["spans"] if s["kind"] == 3]
    assert len(found(8)) == 2 and len(found(10)) == 1 and not found(2) and not found(9)
    assert secrets.scan(docs(spark, rows).limit(0)).count() == 0


def test_secret_scan_has_power_and_few_false_discoveries(spark):
    _, key = secret_texts()
    lower, both = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    kinds = {1: (both + "0123456789", 24), 2: ("0123456789abcdef", 31), 3: (both + "0123456789+/", 44), 4: (lower, 150), 5: (both, 40), 6: (lower + "0123456789", 60)}
    rows = ordinary_runs(2) + [(1000 * k + i, "k " + key(n, a), None, None) for k, (a, n) in kinds.items() for i in range(60)]
    rows += [(1, "=" * 40, None, None), (2, "-" * 40, None, None), (3, "a" + "=" * 30, None, None), (4, "0" * 30, None, None), (5, "com/articles/2024/why-the-quick-brown-fox", None, None)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs(spark, rows)).collect()}
    power = {}
    for k, (_, n) in kinds.items():
        found = [got[1000 * k + i] for i in range(60)]
        power[k] = sum(map(bool, found)) / 60
        assert all((s["start"], s["end"]) == (2, 2 + n) for spans in found for s in spans if s["kind"] == 3)
    flagged = sum(bool(got[i]) for i in got if i < 60 or i >= 50_000)
    assert flagged <= 2 * secrets.Q * sum(map(bool, got.values())) and not any(got[i] for i in range(1, 6))
    if short := {k: round(p, 2) for k, p in power.items() if p < 0.9}:
        # keys are a tenth of all runs here and so part of the null model that they are held against
        pytest.xfail(f"the scan finds too few keys of these kinds: {short}")


def test_secret_matches_take_linear_time_and_keep_places(spark):
    t = "é " + " ".join(f"{'x' * (12 + i % 5)}{'😀' * (i % 2)}" for i in range(3000))
    spans = spark.createDataFrame([(t,)], "t string").select(secrets.matches(F.col("t"), secrets.CANDIDATE).alias("m")).first()["m"]
    assert [(s["start"], s["end"], s["s"]) for s in spans] == [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.CANDIDATE, t)]
