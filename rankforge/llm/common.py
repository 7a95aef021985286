"""Helpers shared by the corpus operators: shared storage, word hashing, packed lookups, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting that shuffle files go when the query that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes materialized tables that no later step reads."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(col, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(col).cast("string")) % n


def salted_lookup(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 16, how: str = "left") -> DataFrame:
    """left joined with right, which has one row a key; each key of left is dealt over several tasks by a hash of by."""
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(many, [key, "_salt"], how).drop("_salt")


#: Keys that hold more than 1 / HEAVY of all rows are dealt over SALTS tasks; there are fewer than HEAVY of them, whatever the data.
HEAVY, SALTS = 1000, 32


def with_values(rows: DataFrame, values: DataFrame, key: str, weight: str, by: str) -> DataFrame:
    """rows whose key is in values, a stored table of a row a key, with its other columns.

    weight says how many rows a key has. Rows of the fewer than HEAVY keys that have more than 1 / HEAVY of all are
    dealt by a hash of by, and these keys' values repeated for each of their tasks.
    """
    limit = (values.agg(F.sum(weight)).first()[0] or 0) / HEAVY
    heavy = [r[0] for r in values.filter(F.col(weight) > limit).select(key).collect()]  # fewer than HEAVY
    salts = lambda col: F.when(col.isin(heavy), F.lit(SALTS)).otherwise(1) if heavy else F.lit(1)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), salts(F.col(key))).cast("int"))
    many = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts(F.col(key)) - 1)))
    return dealt.join(many, [key, "_salt"]).select(*rows.columns, *[c for c in values.columns if c != key])


# --- vectorised words -----------------------------------------------------------------------------

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _PINV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[_LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        for name, base in (("up", _P), ("down", _PINV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """Ranges of rows whose texts together have at most so many bytes, or one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Bytes between runs of letters; bytes of other scripts count as letters.
NOT_LETTER = ~((np.arange(256) >= 128) | ((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122))


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SEP, values: np.ndarray = _BYTE_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, and the number of words in each; values: of bytes, as given lower-cased (A-Z)."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    word = ~between[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] = word[begin]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    up, down = powers(n)
    each = values[data]
    each *= up[:n]
    each *= word
    return mix(np.add.reduceat(each, starts) * down[starts]), counts


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all ids in edges; component is the smallest id that links reach.

    Every id's label falls to the least label near it and then to its label's label, until nothing changes.
    """
    both = materialize(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct())
    labels = materialize(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.min("x")).alias("component")))
    while True:
        near = both.join(labels, both.y == labels.id).groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        step = materialize(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = materialize(step.join(up, "component").select("id", "old", F.least("component", "above").alias("component")))
        discard(labels, step)
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("id", "component")
        labels._stored_at = new._stored_at
        if not changed:
            discard(both)
            return labels


#: Ids that may be sent to every executor, some 20 bytes each; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """docs whose key is (left_semi) or is not (left_anti) in ids, a stored table of that one column.

    Texts stay where they are unless there are more than BROADCAST_IDS ids.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)
