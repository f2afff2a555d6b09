"""What is kept between checks: snapshots, a portable index, versions of files, and retention."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import changes

CONFIG_NAME = ".vmd/config.yaml"


def input_digest(config: str | None, schemas: dict[str, str], aliases: str | None) -> str:
    """SHA-256 over everything besides the records that a check depends on."""
    parts = [config, sorted(schemas.items()), aliases]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def save_snapshot(files: DataFrame, refs: DataFrame, digest: str, folder: str) -> None:
    """Versions and resolved references of a full check; the digest goes last, so a half-written snapshot has none."""
    files.select("path", "version").write.mode("overwrite").parquet(f"{folder}/files")
    refs.write.mode("overwrite").parquet(f"{folder}/refs")
    files.sparkSession.createDataFrame([(digest,)], "digest string").coalesce(1).write.mode("overwrite").json(f"{folder}/digest")


def is_current(spark: SparkSession, files: DataFrame, digest: str, folder: str) -> bool:
    """Whether the snapshot has exactly these versions and this digest. Stops at the first difference."""
    stored = spark.read.json(f"{folder}/digest").first()
    if stored is None or stored["digest"] != digest:
        return False
    return changes(spark.read.parquet(f"{folder}/files"), files.select("path", "version")).isEmpty()


def changed_since(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Paths added, removed or modified since the snapshot."""
    return changes(spark.read.parquet(f"{folder}/files"), files.select("path", "version"))


def portable_index(tables: dict[str, DataFrame], folder: str) -> None:
    """JSON Lines tables under names made from their content's hash, and a manifest written last.

    A table's hash is an order-free sum over its rows, so the same rows get the same name on every run.
    """
    manifest = {}
    for name, df in sorted(tables.items()):
        row = F.xxhash64(F.to_json(F.struct(*df.columns)))
        n, total = df.agg(F.count("*"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0))).first()
        label = hashlib.sha256(f"{n}:{total}".encode()).hexdigest()[:16]
        df.write.mode("overwrite").json(f"{folder}/{name}-{label}")
        manifest[name] = {"path": f"{name}-{label}", "rows": n}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_portable(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    return {name: spark.read.json(f"{folder}/{entry['path']}") for name, entry in manifest.items()}


def at_revision(history: DataFrame, revision: int) -> DataFrame:
    """Files (path, version, ...) as of a revision: each path's last entry (path, revision, version, removed, ...)."""
    rest = [c for c in history.columns if c not in ("path", "revision")]
    last = history.where(F.col("revision") <= revision).groupBy("path").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("path", "r.*")
    return last.where("not removed").drop("removed")


def head(history: DataFrame) -> DataFrame:
    return history.agg(F.max("revision").alias("head"))


def log(history: DataFrame, path: str) -> DataFrame:
    """A path's entries, newest first."""
    return history.where(F.col("path") == path).orderBy(F.desc("revision"))


def retain(index: DataFrame, current: DataFrame, days: int = 30) -> DataFrame:
    """Index entries that are current or were read within so many days."""
    live = current.select("version").distinct().withColumn("live", F.lit(True))
    recent = F.col("read_at") >= F.current_timestamp() - F.expr(f"INTERVAL {int(days)} DAYS")
    return index.join(live, "version", "left").where(F.col("live") | recent).drop("live")


def discover(start: str, has: "callable") -> str | None:
    """The nearest folder from `start` upwards that has a configuration; has(path) tells whether a file exists."""
    here = PurePosixPath(start)
    for folder in (here, *here.parents):
        if has(str(folder / CONFIG_NAME)):
            return str(folder)
    return None
