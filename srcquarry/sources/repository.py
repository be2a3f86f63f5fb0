"""Source files of a directory: discovery with ignore, link and size guards, and a Spark data source."""

from __future__ import annotations

import os
import stat
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.identity import MAX_FILE_BYTES, content_hash
from ..functions.routing import WALK_SKIP, route_language
from ..functions.text import decode

BATCH = 256


def safe_source(root: str, path: str) -> bool:
    """Whether a file may be read: inside the root, reached without a link, regular, and at most 1 MiB."""
    base = os.path.realpath(root)
    inside = os.path.relpath(os.path.abspath(path), os.path.abspath(root))
    full = os.path.join(base, inside)
    if inside.split(os.sep)[0] == os.pardir or os.path.realpath(full) != full:
        return False
    try:
        info = os.lstat(full)
    except OSError:
        return False
    return stat.S_ISREG(info.st_mode) and info.st_size <= MAX_FILE_BYTES


def tracked_names(root: str) -> set[str] | None:
    """Names that version control knows or would add; None where it does not manage the folder. Its failures are raised."""
    try:
        run = subprocess.run(
            ["git", "ls-files", "--cached", "--others", "--exclude-standard", "-z"], cwd=root, capture_output=True, env={**os.environ, "LC_ALL": "C"}
        )
    except FileNotFoundError:
        return None
    if run.returncode == 128 and b"not a git repository (or any" in run.stderr:
        return None
    run.check_returncode()
    return {os.fsdecode(name) for name in run.stdout.split(b"\0") if name}


def source_paths(root: str) -> list[str]:
    """Relative paths of the files that may be read, sorted.

    One pass over the folders tells links, kinds and sizes; links are never followed. Version control decides which
    files count and so which folders are entered; without it, folders of dependencies and builds are left out.
    """
    names = tracked_names(root)
    folders = None
    if names is not None:
        folders = {name[:i] for name in names for i, c in enumerate(name) if c == os.sep}
    found, todo = [], [""]
    while todo:
        folder = todo.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for entry in entries:
                path = os.path.join(folder, entry.name)
                if entry.is_dir(follow_symlinks=False):
                    if path in folders if folders is not None else entry.name.lower() not in WALK_SKIP:
                        todo.append(path)
                elif entry.is_file(follow_symlinks=False) and (names is None or path in names) and entry.stat(follow_symlinks=False).st_size <= MAX_FILE_BYTES:
                    found.append(path)
    return sorted(found)


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def partitions(self) -> list[InputPartition]:
        paths = source_paths(self.root)
        return [_Paths(paths[i : i + BATCH]) for i in range(0, len(paths), BATCH)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(self.root, path)
            if not safe_source(self.root, full):
                raise RuntimeError(f"the source changed while it was read: {path}")
            with open(full, "rb") as f:
                yield path.replace(os.sep, "/"), full, bytes(f.read())


class RepositorySource(DataSource):
    """``spark.read.format("repository").load(dir)``: relative_path, file_path, content."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "relative_path string, file_path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def repository_files(spark: SparkSession, root: str) -> DataFrame:
    """Files some language reads: ``relative_path``, ``file_path``, ``language``, ``sha256``, ``text``."""
    spark.dataSource.register(RepositorySource)
    files = spark.read.format("repository").load(os.path.abspath(root))
    routed = files.withColumn("language", route_language(F.col("relative_path"))).where(F.col("language").isNotNull())
    return routed.select("relative_path", "file_path", "language", content_hash(F.col("content")).alias("sha256"), decode(F.col("content")).alias("text"))
