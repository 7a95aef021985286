"""The pipeline on a small folder of tables, and its stages on odd rows."""

import random

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    rng = random.Random(1)
    en, de = "the cat sat on the mat and ran home again today".split(), "der hund lief nach hause und schlief dort lange".split()
    out = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        t = " ".join(rng.choice(en if lang == "en" else de) + (str(rng.randrange(99)) if rng.random() < 0.2 else "") for _ in range(50))
        out.append((i, t, lang, rng.choice(["a", "b", None])))
    return out + [(100 + i, out[0][1], "en", "a") for i in range(5)] + [(200, out[1][1] + " token=abcdefgh12345678", "de", "b"), (201, None, None, None), (202, "", "en", "a"), (203, "12345", None, "b")]


def test_pipeline(spark, tmp_path):
    data = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows()]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == COLUMNS
    ids = {n: {r["doc_id"] for r in x} for n, x in kept.items()}
    assert ids["language ID"] == {i for i, *_ in rows()} - {201, 202, 203}
    assert ids["n-gram Jaccard join"] == ids["language ID"] - {100, 101, 102, 103, 104, 200}
    assert len(kept["secret scans"]) == len(kept["n-gram Jaccard join"])
    words = lambda x: sum(len((r["text"] or "").split()) for r in x)
    assert words(kept["mixing sources to target weights"]) == int(1.5 * words(kept["secret scans"]))
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in kept["SentencePiece encoding and decoding"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["SentencePiece encoding and decoding"])


def test_secrets_are_masked(spark):
    docs = spark.createDataFrame([(1, "my token=abcdefgh12345678 is", "en", "a", 5)], COLUMNS)
    row = corpus_pipeline.secret_masks(spark, docs, "").first()
    assert row["text"] == "my <secret> is" and row["n_chars"] == len(row["text"])


def test_rows_of_one_id_or_none_stay_apart(spark):
    rng = random.Random(4)
    text = lambda n=60: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, text(), "en", "a", 1) for i in (None, None, 7, 7, 7)]
    rows += [rows[2], (None, "", "en", "a", 0), (None, "", "en", "a", 0), (3, rows[0][1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    want = [rows[1], *rows[2:5], rows[6], rows[7], rows[8]]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
    words = lambda x: sum(len(r["text"].split()) for r in x)
    mixed = corpus_pipeline.mixture(spark, docs, "").collect()
    assert 0 <= int(1.5 * words(docs.collect())) - words(mixed) < 3 and {r["text"] for r in mixed} >= {r[1] for r in rows if r[1]}


def test_passes_of_a_document_are_segmented_for_themselves(spark):
    row = (1, "internationalisation of the unforgettable " * 20, "en", "a", 5)
    docs = spark.createDataFrame([row, row], COLUMNS)
    got = [corpus_pipeline.encoding(spark, docs, "").collect() for _ in range(2)]
    assert len({tuple(r["ids"]) for r in got[0]}) == 2 and sorted(map(str, got[0])) == sorted(map(str, got[1]))


def test_near_duplicates_are_by_five_words_at_four_fifths(spark):
    words = [f"w{i}" for i in range(50)]
    changed = [*words[:25], "other", *words[26:]]
    rows = [(1, " ".join(words), "en", "a", 1), (2, " ".join(changed), "en", "a", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]


def test_columns_that_clash_stay(spark, tmp_path):
    data = [(i, t, lang, s, len(t or ""), 7.5, ["x"], 3, "b", [1], i) for i, t, lang, s in rows()[:40]]
    more = ["score", "langs", "size", "base", "spans", "taken"]
    docs = spark.createDataFrame(data, [*COLUMNS, *more])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [*COLUMNS, *more]
    got = docs.collect()
    assert got and all((r["score"], r["langs"], r["size"], r["base"], r["spans"], r["taken"]) == (7.5, ["x"], 3, "b", [1], r["doc_id"]) for r in got)


def test_stages_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
