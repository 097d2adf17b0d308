"""Folders of media files as a Spark data source: read in parts, without following links, with what could not be read.

A part is a folder (or a file) that was named, or a folder directly in one; tasks walk their parts by themselves. The paths are those of
a file system that all executors have mounted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cadenza.functions import text as t
from cadenza.sources.media import AUDIO, VIDEO

MAX_FILES = 10_000
EXTENSIONS = tuple(f".{x}" for x in VIDEO + AUDIO)
INTERMEDIATE = ".asr.flac"
SCHEMA = "path string, size long, problem string"


def _is_link(path: str) -> bool:
    return os.path.islink(path) or (hasattr(os.path, "isjunction") and os.path.isjunction(path))


def _wanted(name: str) -> bool:
    return name.lower().endswith(EXTENSIONS) and not name.lower().endswith(INTERMEDIATE)


def _entries(folder: str) -> tuple[list[os.DirEntry], str | None]:
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: (e.name.casefold(), e.name)), None
    except OSError as error:
        return [], error.strerror or type(error).__name__


def _file(path: str) -> tuple:
    try:
        size = os.stat(path, follow_symlinks=False).st_size
    except OSError as error:
        return path, None, error.strerror or type(error).__name__
    return path, size, None if size > 0 else "empty"


def _walk(folder: str, recursive: bool) -> Iterator[tuple]:
    """(path, size, problem) of media files in a folder; links are passed over."""
    todo = [folder]
    while todo:
        current = todo.pop()
        entries, problem = _entries(current)
        if problem:
            yield current, None, problem
        deeper = []
        for entry in entries:
            if _is_link(entry.path):
                continue
            if entry.is_dir(follow_symlinks=False):
                deeper.append(entry.path)
            elif _wanted(entry.name):
                yield _file(entry.path)
        if recursive:
            todo += reversed(deeper)


class _Part(InputPartition):
    def __init__(self, path: str, recursive: bool):
        super().__init__(path)
        self.path, self.recursive = path, recursive


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.limit = int(options["limit"]) if options.get("limit") else None

    def partitions(self) -> list[_Part]:
        parts = []
        for path in dict.fromkeys(os.path.abspath(os.path.expanduser(p)) for p in self.paths):
            parts.append(_Part(path, False))  # what was named, and the files directly in it
            if self.recursive and os.path.isdir(path) and not _is_link(path):
                parts += [_Part(e.path, True) for e in _entries(path)[0] if not _is_link(e.path) and e.is_dir(follow_symlinks=False)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        path, found = partition.path, 0
        if _is_link(path):
            yield path, None, "link"
        elif os.path.isdir(path):
            for row in _walk(path, partition.recursive):
                yield row
                found += row[2] is None
                if self.limit is not None and found > self.limit:
                    return  # one more than may be: the folder is refused
        elif not os.path.exists(path):
            yield path, None, "missing"
        elif not path.lower().endswith(INTERMEDIATE):
            yield _file(path) if _wanted(path) else (path, None, "extension")


class MediaFolders(DataSource):
    """Options: ``paths`` (a JSON list), ``recursive`` (true), ``limit`` (none): a part ends after so many files and one."""

    @classmethod
    def name(cls) -> str:
        return "media_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def scan(spark: SparkSession, paths: list[str], recursive: bool = True, limit: int | None = None) -> DataFrame:
    """(path, size, problem) under ``paths``: files that are accepted have no problem. Each path once, by its folded form; accepted before rejected."""
    spark.dataSource.register(MediaFolders)
    rows = spark.read.format("media_folders").option("paths", json.dumps(paths)).option("recursive", str(recursive).lower())
    rows = (rows if limit is None else rows.option("limit", str(limit))).load()
    best = F.max_by(F.struct("path", "size", "problem"), F.struct(F.col("problem").isNull(), "path")).alias("r")
    return rows.groupBy(t.folded(F.col("path")).alias("_key")).agg(best).select("r.*").orderBy(t.folded(F.col("path")), "path")


def accepted(spark: SparkSession, paths: list[str], recursive: bool = True, limit: int = MAX_FILES) -> DataFrame:
    """(path, size) in order of the folded path; more than ``limit`` files, or a rejected one, is an error."""
    found = scan(spark, paths, recursive, limit)
    bad = found.where("problem is not null").first()
    if bad is not None:
        raise ValueError(f"{bad.path}: {bad.problem}")
    good = found.select("path", "size")
    if good.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} files")
    return good
