"""Extraction that reuses what unchanged files gave before, in batches or from a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def split(sources: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed sources, paths to reuse): files whose text has another hash than in ``cached`` (path, hash),
    and those that have the same. Files that are gone are in neither."""
    now = sources.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    old = cached.select("path", "hash").distinct()
    return now.join(old, ["path", "hash"], "left_anti"), now.select("path", "hash").join(old, ["path", "hash"], "left_semi")


def stats(sources: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: files in all, reused and to be read again."""
    changed, same = split(sources, cached)
    return changed.agg(F.count("*").alias("reparsed")).crossJoin(same.agg(F.count("*").alias("reused"))).select((F.col("reused") + F.col("reparsed")).alias("total"), "reused", "reparsed")  # one row each


def follow(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run ``extract`` over each batch of a stream of (path, text) and keep the rows by batch.

    A batch that is run again overwrites its own folder, so rows come out once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update(sources: DataFrame, cached: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``extract`` gives for (path, text), with the hash of each file: those of unchanged files come
    from ``cached`` (file, hash and the rows), only changed files are read again, and files that are gone drop out."""
    marks = sources.select(F.col("path").alias("file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    changed, _ = split(sources, cached.select(F.col("file").alias("path"), "hash"))
    fresh = extract(changed.select("path", "text")).join(marks, "file")
    kept = cached.join(marks, ["file", "hash"], "left_semi")
    return kept.unionByName(fresh.select(kept.columns))
