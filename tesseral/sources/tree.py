"""A directory tree as rows, found by tasks that widen its frontier.

Each round the directories that are still to be listed are dealt to tasks; a task lists its own and goes
on below them up to a number of directories, and hands back the rest. So a wide tree takes a few rounds,
a narrow one few tasks, and no task or driver sees the whole. Empty directories, hidden names and the
targets of links are seen, which Spark's file sources leave out.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.working import new_path
from .places import located

#: `kind` is file, directory or other (a link that leads nowhere, a device); `link` tells links;
#: `resolved` is the path without any. `listed` is false for directories that another round lists.
ENTRIES = "path string, parent string, name string, kind string, link boolean, resolved string, size long, listed boolean"
#: Directories that a task lists in a round, for each that it was given.
REACH = 1000


def _local(folder: str) -> list[tuple]:
    out = []
    with os.scandir(folder) as entries:
        for e in entries:
            link = e.is_symlink()
            kind = "directory" if e.is_dir() else "file" if e.is_file() else "other"
            out.append((e.path, folder, e.name, kind, link, os.path.realpath(e.path), e.stat().st_size if kind == "file" else None))
    return out


def _stored(files, folder: str) -> list[tuple]:
    from pyarrow import fs

    kinds = {fs.FileType.File: "file", fs.FileType.Directory: "directory"}
    return [(i.path, folder, i.base_name, kinds.get(i.type, "other"), False, i.path, i.size) for i in files.get_file_info(fs.FileSelector(folder))]


def _lister(scheme: str, reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for start in batch.path:
                files, first = located(scheme + start)
                local = isinstance(files, fs.LocalFileSystem)
                todo, listed = deque([first]), 0
                while todo and listed < reach:
                    found = _local(todo.popleft()) if local else _stored(files, todo.popleft())
                    listed += 1
                    # links to directories are told of and not entered, so no tree is endless
                    todo += [p for p, _, _, kind, link, *_ in found if kind == "directory" and not link]
                    yield pd.DataFrame([(*e, True) for e in found], columns=[c.split()[0] for c in ENTRIES.split(", ")])
                yield pd.DataFrame([(p, None, None, None, None, None, None, False) for p in todo], columns=[c.split()[0] for c in ENTRIES.split(", ")])

    return run


def tree(spark: SparkSession, root: str, *, reach: int = REACH) -> DataFrame:
    """(path, parent, name, kind, link, resolved, size) of everything below a directory, in no order.
    Paths are those of the store, without its scheme. Raises if the root is no directory."""
    from pyarrow import fs

    files, top = located(root)
    if files.get_file_info(top).type != fs.FileType.Directory:
        raise NotADirectoryError(root)
    scheme = "" if isinstance(files, fs.LocalFileSystem) else root[: root.index(top.split("/", 1)[0])]
    frontier, rounds = spark.createDataFrame([(top.rstrip("/"),)], "path string"), []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        at = new_path(spark, "-tree")
        # the deal is by path: a task that runs again lists the same directories
        frontier.repartition(tasks if rounds else 1, "path").mapInPandas(_lister(scheme, reach), ENTRIES).write.mode("overwrite").parquet(at)
        found = spark.read.schema(ENTRIES).parquet(at)
        rounds.append(at)
        frontier = found.where("not listed").select("path")
        if frontier.isEmpty():
            break
    return spark.read.schema(ENTRIES).parquet(*rounds).where("listed").drop("listed")


def image_dirs(entries: DataFrame) -> DataFrame:
    """(image_dir) of all directories named `images`, empty ones too, links to directories as well."""
    return entries.where("name = 'images' and kind = 'directory'").select(F.col("path").alias("image_dir"))


def images_of(entries: DataFrame, ending: str = ".jpg") -> DataFrame:
    """(image_dir, path, filename, resolved) of each image directory's own images; a directory without
    any has one row of nulls, so that it is counted as too small rather than forgotten."""
    own = entries.where((F.col("kind") != "directory") & F.col("name").endswith(ending)).select(F.col("parent").alias("image_dir"), "path", F.col("name").alias("filename"), "resolved")
    return image_dirs(entries).join(own, "image_dir", "left")


def aliased(picks: DataFrame, group: list[str], resolved: str | Column = "resolved") -> DataFrame:
    """For every group of picks whether it is rejected because two of them are one file."""
    counted = picks.groupBy(*group).agg(F.count("*").cast("int").alias("n_picks"), F.countDistinct(resolved).cast("int").alias("n_distinct"))
    reason = F.when(F.col("n_distinct") < F.col("n_picks"), "Selected images must have distinct resolved paths")
    return counted.withColumn("rejected", reason.isNotNull()).withColumn("reason", reason)
