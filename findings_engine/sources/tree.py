"""A lister of source trees as a Python data source.

Spark's file sources leave out names that begin with an underscore or a dot,
which loses package initialisers and example environments; this keeps hidden
files, and prunes skipped and hidden directories before it descends. The walk
is the driver's, one partition for FILES_PER_TASK files; contents are read in
the tasks, so the root must be a path that they see.
"""

from __future__ import annotations

import os
import subprocess
import sys
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.rx import SKIP_DIRS

FILES_PER_TASK = 500


def walked(
    root: str, extensions: frozenset[str] | None, excluded: frozenset[str], vault: str | None, skip: frozenset[str] = frozenset()
) -> Iterator[str]:
    """Relative paths as the walk comes to them; symbolic links that leave the root are left out."""
    root = os.path.realpath(root)
    skip = skip | set(SKIP_DIRS)
    vault = os.path.realpath(vault) if vault else None
    for here, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip and not d.startswith("."))
        if vault and (here == vault or here.startswith(vault + os.sep)):
            dirs[:] = []
            continue
        for name in sorted(files):
            ext = os.path.splitext(name)[1][1:]
            full = os.path.join(here, name)
            rel = os.path.relpath(full, root).replace(os.sep, "/")
            if (extensions is None or ext in extensions) and rel not in excluded and os.path.realpath(full).startswith(root + os.sep):
                yield rel


def listed(
    root: str, extensions: frozenset[str] | None, excluded: frozenset[str], vault: str | None, max_files: int, skip: frozenset[str] = frozenset()
) -> list[str]:
    """The first max_files of the walk, in code-point order."""
    return sorted(islice(walked(root, extensions, excluded, vault, skip), max_files))


def count_files(root: str, extensions: frozenset[str] | None, limit: int, skip: frozenset[str] = frozenset()) -> int:
    """How many files a scan would read; the walk ends at limit + 1, which says: more."""
    return sum(1 for _ in islice(walked(root, extensions, frozenset(), None, skip), limit + 1))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        ext = options.get("extensions")
        self.extensions = frozenset(ext.split(",")) if ext else None
        self.excluded = frozenset(x for x in options.get("exclude", "").split(",") if x)
        self.vault = options.get("vault")
        self.contents = options.get("contents", "true") == "true"
        self.max_files = int(options.get("maxFiles", sys.maxsize))
        self.skip = frozenset(x for x in options.get("skip", "").split(",") if x)

    def partitions(self):
        paths = listed(self.root, self.extensions, self.excluded, self.vault, self.max_files, self.skip)
        return [_Files(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for rel in partition.paths:
            if not self.contents:
                yield rel, None
                continue
            try:
                with open(os.path.join(self.root, rel), "rb") as f:
                    yield rel, f.read()
            except OSError:  # an unreadable file has no definitions; it is still a file
                yield rel, None


class SourceTree(DataSource):
    """Options: extensions, exclude (relative paths), skip (names of directories), vault, contents, maxFiles."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)


def vcs_state(root: str, timeout: float = 10.0) -> tuple[str | None, bool | None]:
    """(commit, dirty), each None where it can't be told."""

    def git(*args: str) -> str | None:
        try:
            got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, check=True)
            return got.stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    commit, changes = git("rev-parse", "HEAD"), git("status", "--porcelain")
    return commit or None, None if changes is None else bool(changes)
