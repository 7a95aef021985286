"""A corpus pipeline over documents: language, near duplicates, secrets, mixture, pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm import jaccard, langid, mixing, pieces, secrets
from rankforge.llm.common import by_ids, discard, materialize, remainder, shared_dir, table

#: A document whose dominant language has a smaller share is no text of one language.
LEAST_SHARE = 0.4


def hidden(docs: DataFrame, *shown: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those shown under numbers, so that no operator's column clashes, and the way back."""
    names = [c if c in shown else f"_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters in which one language has LEAST_SHARE at least; lang takes what was found."""
    model = langid.learn(docs.filter(remainder("doc_id", 5) != 0))
    rows, back = hidden(docs, "doc_id", "text", "lang")
    found = langid.identify(rows, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return back(found.withColumn("lang", F.col("lang_pred")))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, a hash of all columns: rows of one id, or of none, stay apart unless they are equal throughout."""
    return docs.withColumn("_key", F.xxhash64(*docs.columns))


def once(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """rows with one of each group of equal ones whose _key is in twice, a stored table."""
    if not twice.limit(1).count():
        return rows
    return by_ids(rows, twice, "left_anti", "_key").unionByName(by_ids(rows, twice, "left_semi", "_key").dropDuplicates(["_key"]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group that 5-word shingles link at 0.8.

    Groups are of rows, not of ids: rows that share an id, or have none, go only if they are linked.
    """
    rows = keyed(docs)
    groups = jaccard.components(rows.select(F.col("_key").alias("doc_id"), "text"), 5, 80, 100)
    known = groups.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.first("component_id").alias("component"), F.count("*").alias("copies"))
    known = materialize(known.join(rows.select("_key", "doc_id").distinct(), "_key"))
    first = known.groupBy("component").agg(F.min_by("_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = materialize(known.join(first, "component").filter("_key <> first").select("_key"))
    twice = materialize(known.filter("copies > 1").select("_key"))
    return once(by_ids(rows, later, "left_anti", "_key"), twice).select(*docs.columns)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, their secrets replaced by a mark; n_chars follows the text."""
    rows, back = hidden(docs, "doc_id", "text", "n_chars")
    found = secrets.scan(rows, text=True)
    masked = found.withColumn("text", secrets.masked(F.col("text"), F.col("spans")))
    return back(masked.withColumn("n_chars", F.char_length("text").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents as the mixture of sources takes them; one at the limit gives its first words.

    What is taken follows from the row and its source's queue, so texts are neither joined nor shuffled.
    """
    rows, back = hidden(docs, "text", "source", "n_chars")
    key = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    rows = mixing.sized(rows.withColumn("doc_id", key), *[c for c in rows.columns if c != "source"])
    taken = mixing.take(rows, mixing.queue(rows)).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = F.col("taken") % F.col("size")
    pieces_of = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces_of, F.lit(1), rest.cast("int")), "")
    texts = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    out = taken.withColumn("text", F.explode(texts)).withColumn("n_chars", F.char_length("text").cast("long"))
    return back(out)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the pieces of each text, as ids, and their number; each pass of a repeated document is segmented for itself."""
    passes = keyed(docs).withColumn("_pass", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    return pieces.encode(passes, by=("_key", "_pass")).drop("_key", "_pass").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_masks),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoding),
]

#: Learned models, connected components and pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each stage's rows written as Parquet and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        done = materialize(stage(spark, docs, sf_dir))
        if i:
            discard(docs)  # the stage before, which nothing reads again
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
