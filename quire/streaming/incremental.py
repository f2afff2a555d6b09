"""Increments: content-addressed reuse, change feeds, and streams that parse or check only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unseen(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files whose version has no parse yet. Versions are content ids, so a moved or restored file is not parsed again."""
    return files.join(parsed.select("version").distinct(), "version", "left_anti")


def latest(feed: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """The row with the greatest seq of each key: one partial aggregation, no sort of a key's whole history."""
    rest = [c for c in feed.columns if c not in (key, seq)]
    return feed.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def merged(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base (path, version, ...) after a set of changes (same columns and `removed`): an anti join and a union."""
    gone = changes.select("path").distinct()
    kept = base.join(gone, "path", "left_anti")
    return kept.unionByName(changes.where("not removed").drop("removed"))


class ConflictError(RuntimeError):
    """A write whose expected version isn't the current one."""


def apply(base: DataFrame, writes: DataFrame) -> DataFrame:
    """base after writes (path, expected, version, content): all of them, or ConflictError.

    expected is the version a writer saw, null for a new path; a null version deletes.
    """
    now = base.select("path", F.col("version").alias("current"))
    stale = writes.join(now, "path", "left").where(~F.col("expected").eqNullSafe(F.col("current"))).select("path", "expected", "current")
    first = stale.limit(3).collect()
    if first:
        raise ConflictError("; ".join(f"{r['path']} is at {r['current']}, not {r['expected']}" for r in first))
    new = writes.drop("expected").withColumn("removed", F.col("version").isNull())
    return merged(base, new.select(*base.columns, "removed"))


def stream_files(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int | None = None) -> DataFrame:
    """A stream of new files below a folder: path, content, size and modified."""
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return reader.schema(schema).load(folder).select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def publish(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parses every micro-batch's unseen versions and appends them to the Parquet folder `table`.

    A replayed batch finds its own versions there and appends nothing, so restarts publish once. Files that can't be
    parsed are published with their issues and never hold up a batch.
    """
    from ..functions.text import git_blob_id

    def batch(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        versioned = files.withColumn("version", git_blob_id(F.col("content"))).dropDuplicates(["version"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        fresh = unseen(versioned, spark.read.parquet(table)) if there else versioned
        parse(fresh).write.mode("append").parquet(table)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def windowed_counts(stream: DataFrame, by: str, size: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Changes per window and key with a watermark: late rows within it still count, state beyond it is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
