"""Tables on shared storage: append, backup and restore, reset, counts, stored intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKING_TABLES = ("rating_history", "player_ratings")
PARSED_TABLES = ("players", "games", "tournaments", "matches", "match_maps", "maps", "player_aliases", "match_vods", "tournament_brackets")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only for a local session that has none."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


#: Writer's options for tables of long values: a page of the file is closed by its size after any row, not after a hundred at
#: least. Readers and writers hold a page whole, outside the heap too.
LONG_VALUES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.check.estimate": "false"}


def stored(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of input for each partition of a shuffle, and bytes of files and shuffles that a task takes.
ROWS, BYTES = 50_000, 16 << 20


def stored_in_portions(df: DataFrame, rows: int) -> DataFrame:
    """stored, worked out by so many tasks as rows of input need, so that what a task sorts and holds does not grow with them.

    Small inputs keep the session's settings; for larger ones they are changed while df is written.
    """
    spark = df.sparkSession
    need = -(-rows // ROWS)
    if need <= spark.sparkContext.defaultParallelism:
        return stored(df)
    shuffles, *sizes = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    before = {c: spark.conf.get(c) for c in (shuffles, *sizes)}
    try:
        spark.conf.set(shuffles, str(max(need, int(before[shuffles]))))
        for c in sizes:
            spark.conf.set(c, f"{BYTES}b")
        return stored(df)
    finally:
        for c, was in before.items():
            spark.conf.set(c, was)


def append(df: DataFrame, folder: str, name: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as one directory of zstd Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: read(spark, folder, name) for name in names}


def reset_posts(posts: DataFrame) -> DataFrame:
    """Parsed and skipped posts become downloaded again; times stay, discovered posts are untouched."""
    again = F.col("status").isin("parsed", "skipped")
    return posts.withColumn("reason", F.when(again, "").otherwise(F.col("reason"))).withColumn("status", F.when(again, "downloaded").otherwise(F.col("status")))


def reset(tables: dict[str, DataFrame], target: str, dry_run: bool = True) -> dict[str, DataFrame] | DataFrame:
    """rankings: empties the rating tables; parsed: empties what pages gave and makes posts downloaded again.

    A dry run counts what would go.
    """
    names = RANKING_TABLES if target == "rankings" else PARSED_TABLES
    own = {n: tables[n] for n in names if n in tables}
    if dry_run:
        return table_counts(own)
    out = {n: df.limit(0) for n, df in own.items()}
    if target == "parsed" and "raw_posts" in tables:
        out["raw_posts"] = reset_posts(tables["raw_posts"])
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


#: Files that a series is written in, each by a task of its own.
SHARES = 16


def replace_series(history: DataFrame, folder: str) -> None:
    """Overwrites only the (rating_system, game_id) partitions that history has."""
    spark = history.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        history.repartition("rating_system", "game_id", F.pmod(F.xxhash64("player_id"), F.lit(SHARES))).sortWithinPartitions("player_id", "played_at").write.mode("overwrite").partitionBy("rating_system", "game_id").parquet(f"{folder}/rating_history")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
