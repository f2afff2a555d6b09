"""Trees of a git repository's revisions as files tables. Git reads objects and runs nothing of the working tree."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.listing import changes


class GitError(RuntimeError):
    """No git, no repository, or no such revision."""


def _git(root: str, *args: str) -> bytes:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    except OSError as e:
        raise GitError("git isn't there") from e
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").strip() or f"git {args[0]} failed")
    return done.stdout


def revision_paths(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """(path, version, size) of every file below the root as of a revision; versions are git's own blob ids.

    A revision is one commit's name: no option and no range. The listing has names alone and is read by the driver, as the
    repository is where the driver is.
    """
    if revision.startswith("-") or ".." in revision or not revision:
        raise ValueError(f"{revision!r} is no revision")
    commit = _git(root, "rev-parse", "--verify", "--quiet", f"{revision}^{{commit}}").decode().strip()
    rows = []
    for entry in _git(root, "ls-tree", "-r", "-z", "--long", commit, ".").split(b"\0"):
        if entry:
            about, _, path = entry.partition(b"\t")
            _, kind, blob, size = about.split()
            if kind == b"blob":
                rows.append((path.decode("utf-8", "surrogateescape"), blob.decode(), int(size)))
    return spark.createDataFrame(rows, "path string, version string, size long")


def revision_files(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """A files table (path, content, size) of a revision. Contents are read where rows are, one git process a task, so on a
    cluster the root has to be a shared folder."""
    kind = "path string, content binary, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for batch in batches:
                contents = []
                for blob in batch.column(1).to_pylist():
                    git.stdin.write(blob.encode() + b"\n")
                    git.stdin.flush()
                    length = int(git.stdout.readline().split()[2])
                    contents.append(git.stdout.read(length))
                    git.stdout.read(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary()), batch.column(2)], names=["path", "content", "size"])
            git.stdin.close()

    return revision_paths(spark, root, revision).mapInArrow(run, kind)


def changed_since_revision(files: DataFrame, root: str, revision: str) -> DataFrame:
    """Paths of files (path, version) that differ from a revision by blob id, are new or are gone, tracked by git or not."""
    before = revision_paths(files.sparkSession, root, revision).select("path", "version")
    return changes(before, files.select("path", "version")).select("path")
