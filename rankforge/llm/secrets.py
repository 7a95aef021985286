"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

# The patterns of the base kinds and the least length of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of characters that keys are written in.
CANDIDATE = r"[A-Za-z0-9+/_-]{12,}={0,2}"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Inferred encodings, narrowest first: name, pattern, alphabet. - and _ stand for + and /. Alphabets without small letters fold case.
ENCODINGS = (
    ("digits", r"^[0-9]+=*$", _DIGITS),
    ("letters of one case", r"^(?:[a-z]+|[A-Z]+)=*$", _UPPER),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "234567" + _UPPER),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _UPPER),
    ("letters", r"^[A-Za-z]+=*$", _UPPER),
    ("base62", r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("digits and signs", r"^[0-9+/_=-]+$", _DIGITS + "+/"),
    ("letters and signs", r"^[A-Za-z+/_=-]+$", _UPPER + "+/"),
    ("base64", r"^[0-9A-Za-z+/_=-]+$", _DIGITS + _UPPER + _LOWER + "+/"),
)
#: Upper ends of the length bands in which false discoveries are held apart.
BANDS = (15, 19, 23, 31, 39, 63, 127, 255)
#: Share of ordinary runs among those flagged in a band of an encoding, at most.
Q = 0.01
#: Chance that a random key is thrown away because it does not look random.
ALPHA = 0.001
#: P-values are counted by steps of log10, down to -BINS / STEPS.
STEPS, BINS = 4, 80
#: Matches of a text whose places are added up in one go.
PLACES = 256


def matches(text: Column, pattern: str, keep=None) -> Column:
    """(start, end, s) of all matches of a pattern, leftmost first and not overlapping, in code points.

    The pieces between matches and the matches themselves alternate, so their lengths give the positions. They
    are added up in blocks, so that a text of very many matches takes little more than linear time.
    """
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.char_length(p).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("n"), m.alias("s")))
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    ints = F.array().cast("array<int>")
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731 - value is computed once

    def add(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["n"]).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["s"].alias("s"))).alias("out"))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["gap"] + x["n"]))
        begin = F.aggregate(sums, F.struct(F.lit(0).alias("at"), ints.alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, begin, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])))

    blocks = let(both, lambda x: F.transform(F.sequence(F.lit(1), F.size(x), F.lit(PLACES)), lambda i: F.slice(x, i, PLACES)))
    spans = F.filter(let(blocks, placed), lambda m: m["s"].isNotNull())
    if keep is not None:
        spans = F.filter(spans, keep)
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """(start, kind number, end) of the base kinds in order of start, then kind."""
    assign = matches(text, ASSIGN, lambda m: F.char_length(F.regexp_extract(m["s"], ASSIGN, 2)) >= 8)
    as_kind = lambda spans, k: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
    return F.array_sort(F.concat(as_kind(assign, 0), as_kind(matches(text, ACCESS), 1), as_kind(matches(text, HEX), 2)))


def upper_tail(z: Column) -> Column:
    """1 - Phi(z), by a rational fit with an error below 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) * (1 / math.sqrt(2 * math.pi)) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def split_of(alphabet: str) -> int:
    """Where an alphabet is cut in two for the runs test: between kinds of symbols next to the middle, or there if all are of one kind."""
    kind = lambda c: (c.isdigit(), c.isupper(), c.islower())
    cuts = [i for i in range(1, len(alphabet)) if kind(alphabet[i]) != kind(alphabet[i - 1])]
    return min(cuts, key=lambda i: abs(i - len(alphabet) / 2), default=len(alphabet) // 2)


def scanned(docs: DataFrame, keep_text: bool) -> DataFrame:
    """docs, or just their doc_id, with _base and _cand: (start, end, s, known) of all runs; known ones touch a base span. Stored: texts are scanned once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_base", base_spans(text))
    known = lambda m: F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    runs = F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["s"].alias("s"), known(m).alias("known")))
    out = out.withColumn("_cand", runs)
    return materialize(out if keep_text else out.select("doc_id", "_base", "_cand"))


def ordinary(found: DataFrame) -> list[dict]:
    """For each encoding how runs of ordinary text behave in its alphabet, from all pairs of neighbouring symbols.

    Runs that touch a base span are left out. Pairs are counted over the whole corpus, at most 64 * 64 different
    ones, and pooled over all runs, so that the few runs that are keys hardly count. One pair is added for each
    symbol, spread evenly: an alphabet that no ordinary text uses counts as random, and nothing in it is flagged.
    """
    runs = found.select(F.explode(F.filter("_cand", lambda c: ~c["known"])).alias("c")).select(F.translate(F.col("c.s"), "-_=", "+/").alias("s"))
    pairs = runs.groupBy("s").agg(F.count("*").alias("n")).filter("length(s) > 1")
    pairs = pairs.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair"))
    counts = [(r["pair"], r["n"]) for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()]
    out = []
    for _, _, alphabet in ENCODINGS:
        k = len(alphabet)
        place = {c: i for i, c in enumerate(alphabet)}
        if "a" not in place:
            place |= {c.lower(): i for c, i in place.items()}
        joint = [[1 / k] * k for _ in range(k)]
        for pair, n in counts:
            if pair[0] in place and pair[1] in place:
                joint[place[pair[0]]][place[pair[1]]] += n
        total = sum(map(sum, joint))
        first, second = [sum(row) / total for row in joint], [sum(col) / total for col in zip(*joint)]
        q = [(x + y) / 2 for x, y in zip(first, second)]
        half = [i >= split_of(alphabet) for i in range(k)]
        mean = sum(i * x for i, x in enumerate(q))
        spread = sum((i - mean) ** 2 * x for i, x in enumerate(q))
        cov = sum((i - mean) * (j - mean) * n / total for i, row in enumerate(joint) for j, n in enumerate(row))
        turn = sum(n / total for i, row in enumerate(joint) for j, n in enumerate(row) if half[i] != half[j])
        out.append({"k": float(k), "same": sum(x * x for x in q), "triple": sum(x**3 for x in q), "turn": min(max(turn, 1e-6), 1 - 1e-6), "lag": cov / spread})
    return out


def tested(spans: Column, null: list[dict]) -> Column:
    """Candidates (start, end) with encoding and length band (stratum), p-value's bin, and whether they look random.

    Three tests of the symbols of the inferred alphabet: chi-squared uniformity by coincidences (pairs of equal
    symbols), runs of its two parts, and serial correlation of neighbours. Each is held against both
    hypotheses. Ordinary text (null): p is the chance that text of this encoding and length has so few
    coincidences, so many runs (Chernoff's bound), or neighbours so little related. Random: the two-sided chance
    under even and independent symbols; a run with less than ALPHA does not look random. The least of three
    p-values, times three, bounds the combined one whatever their dependence.
    """
    order = ENCODINGS[-1][2]
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    tail, head = lambda xs: F.slice(xs, F.lit(2), F.size(xs) - 1), lambda xs: F.slice(xs, F.lit(1), F.size(xs) - 1)
    two = lambda z: 2 * upper_tail(F.abs(z))
    ratio = lambda a, b, other: F.when(b > 1e-9, a / F.when(b > 1e-9, b)).otherwise(F.lit(other))
    of = lambda m, name: F.element_at(F.array(*[F.lit(float(p[name])) for p in null]), m["enc"] + 1)
    by_enc = lambda m, values: F.element_at(F.array(*map(F.lit, values)), m["enc"] + 1)
    same = lambda k: lambda m: m[k]

    def with_(xs: Column, **new) -> Column:
        """Adds fields to each struct; a field of one step is a plain value in the next."""
        return F.transform(xs, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), *[f(m).alias(k) for k, f in new.items()]))

    x = with_(spans, s=lambda m: F.translate(m["s"], "-_=", "+/"), enc=lambda m: F.coalesce(*[F.when(F.rlike(m["s"], F.lit(p)), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)]))
    x = F.filter(x, lambda m: F.char_length(m["s"]) > 2)
    folds = [i for i, (*_, alphabet) in enumerate(ENCODINGS) if "a" not in alphabet and "A" in alphabet]
    x = with_(x, enc=same("enc"), s=lambda m: F.when(m["enc"].isin(folds), F.upper(m["s"])).otherwise(m["s"]), alphabet=lambda m: by_enc(m, [a for *_, a in ENCODINGS]))
    x = with_(
        x,
        enc=same("enc"),
        band=lambda m: sum((F.when(F.char_length(m["s"]) > end, 1).otherwise(0) for end in BANDS[1:]), F.when(F.char_length(m["s"]) > BANDS[0], 1).otherwise(0)),
        up=lambda m: F.call_function("translate", m["s"], F.lit(order), by_enc(m, ["".join("1" if c in a and a.index(c) >= split_of(a) else "0" for c in order) for *_, a in ENCODINGS])),
        v=lambda m: F.transform(F.split(m["s"], ""), lambda c: F.instr(m["alphabet"], c).cast("double")),
    )
    keep = {"enc": same("enc"), "band": same("band")}
    x = with_(x, **keep, v=same("v"), n=lambda m: F.size(m["v"]).cast("double"), turns=lambda m: F.regexp_count(m["up"], F.lit("0+|1+")) - 1.0, mid=lambda m: total(m["v"]) / F.size(m["v"]), ones=lambda m: F.char_length(F.translate(m["up"], "0", "")).cast("double"), twice=lambda m: total(F.transform(F.array_distinct(m["v"]), lambda c: F.pow(F.size(F.filter(m["v"], lambda y: y == c)).cast("double"), F.lit(2.0)))))
    x = with_(x, **keep, n=same("n"), turns=same("turns"), ones=same("ones"), equal=lambda m: (m["twice"] - m["n"]) / 2, d=lambda m: F.transform(m["v"], lambda v: v - m["mid"]))
    x = with_(x, **keep, n=same("n"), turns=same("turns"), ones=same("ones"), equal=same("equal"), k=lambda m: of(m, "k"), lag=lambda m: ratio(total(F.zip_with(tail(m["d"]), head(m["d"]), lambda a, b: a * b)), total(F.transform(m["d"], lambda d: d * d)), 1.0) + 1 / m["n"], mean_runs=lambda m: 2 * m["ones"] * (m["n"] - m["ones"]) / m["n"])

    def coincidences(m, p2, p3):
        """How far the number of equal pairs lies above its mean, in deviations, for symbols with these sums of powers."""
        pairs = m["n"] * (m["n"] - 1) / 2
        return (m["equal"] - pairs * p2) / F.sqrt(pairs * p2 * (1 - p2) + m["n"] * (m["n"] - 1) * (m["n"] - 2) * F.greatest(p3 - p2 * p2, F.lit(0.0)))

    def many_turns(m):
        """Chernoff's bound on so many turns between halves, where random symbols turn more often than text does."""
        t, n = of(m, "turn"), m["n"] - 1
        a = F.least(F.greatest(m["turns"] / n, F.lit(1e-9)), F.lit(1 - 1e-9))
        bound = F.exp(-n * (a * F.log(a / t) + (1 - a) * F.log((1 - a) / (1 - t))))
        return F.when((a - t) * (0.5 - t) > 0, bound).otherwise(F.lit(1.0))

    def few_relations(m):
        lag = of(m, "lag")
        return (F.abs(lag) - m["lag"] * F.signum(lag)) * F.sqrt(m["n"]) / (1 - lag * lag)

    x = with_(
        x,
        **keep,
        few=lambda m: -coincidences(m, of(m, "same"), of(m, "triple")),
        turns=many_turns,
        apart=few_relations,
        uneven=lambda m: coincidences(m, 1 / m["k"], 1 / m["k"] / m["k"]),
        runs=lambda m: ratio(m["turns"] - m["mean_runs"], F.sqrt(F.greatest(m["mean_runs"] * (m["mean_runs"] - 1) / (m["n"] - 1), F.lit(0.0))), 40.0),
        lag=lambda m: m["lag"] * F.sqrt(m["n"]),
    )
    combined = lambda *ps: F.least(F.lit(1.0), 3 * F.least(*ps))
    x = with_(x, **keep, p=lambda m: combined(upper_tail(m["few"]), m["turns"], upper_tail(m["apart"])), random=lambda m: combined(upper_tail(m["uneven"]), two(m["runs"]), two(m["lag"])) >= ALPHA)
    return with_(x, stratum=lambda m: m["enc"] * 100 + m["band"], random=same("random"), bin=lambda m: F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(m["p"], F.lit(1e-30))) * STEPS).cast("int")))


def thresholds(cands: DataFrame) -> dict[int, int]:
    """For each stratum (encoding and length band) the least bin that is flagged; strata without one are left out.

    Benjamini-Hochberg on bins: a bin is flagged if m * p / rank <= Q at the bin's largest p, with m runs in the
    stratum and rank of them at p or below. At most len(ENCODINGS) * (len(BANDS) + 1) * (BINS + 1) counts reach the driver.
    """
    counts = cands.select(F.explode("_cand").alias("c")).groupBy("c.stratum", "c.bin").count().collect()
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in counts}:
        mine = sorted(((r["bin"], r["count"]) for r in counts if r["stratum"] == stratum), reverse=True)
        m, rank = sum(c for _, c in mine), 0
        for b, c in mine:
            rank += c
            if m * 10 ** (-b / STEPS) / rank <= Q:
                out[stratum] = b
    return out


def flagged(cand: Column, limits: dict[int, int]) -> Column:
    """Spans of the runs that no ordinary text explains and that look random."""
    limit = lambda c: F.coalesce(*[F.when(c["stratum"] == s, F.lit(b)) for s, b in sorted(limits.items())], F.lit(BINS + 1))
    kept = F.filter(cand, lambda c: c["random"] & (c["bin"] >= limit(c)))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))


def scan(docs: DataFrame, text: bool = False) -> DataFrame:
    """All rows of docs (doc_id, text, ...) with base and spans: arrays of (start, kind, end).

    A null text counts as empty and has no spans. Rows are kept as they are, repeated ones too; spans of equal
    texts are equal. All runs of every row enter the null model and the false-discovery counts, so the added spans
    of a text can change with the corpus around it; base spans cannot. Runs inside base spans are tested as well,
    and flagged ones are added like others. An empty table gives an empty table. With text, the columns of docs
    stay; else only doc_id.
    """
    found = scanned(docs, text)
    keep = docs.columns if text else ["doc_id"]
    tests = found.withColumn("_cand", tested(F.col("_cand"), ordinary(found)))
    spans = F.array_sort(F.concat("_base", flagged(F.col("_cand"), thresholds(tests))))
    return tests.select(*keep, F.col("_base").alias("base"), spans.alias("spans"))


def joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """text with every span replaced by a mark; spans that overlap give one mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc, s):
        new = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, add)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text)))).otherwise(text)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
