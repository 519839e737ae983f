"""Folder trees listed by Spark tasks, level by level; skipped folders are never entered."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactsheet.sources.listing import SKIPPED_FOLDERS
from contactsheet.storage import materialise

#: (name, is a folder, size, modification time) of what a folder holds; raises OSError if it cannot be read.
Entries = Callable[[str], Iterable[tuple[str, bool, int, float]]]


def entries(folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """A folder's entries; links to folders are not followed."""
    with os.scandir(folder) as found:
        for e in found:
            try:
                is_folder = e.is_dir(follow_symlinks=False)
                facts = e.stat()
            except OSError:
                continue
            yield e.name, is_folder, facts.st_size, facts.st_mtime


def _entered(name: str) -> bool:
    return not name.startswith(".") and name.lower() not in SKIPPED_FOLDERS


def walk(spark: SparkSession, root: str, root_id: int = 0, *, list_folder: Entries = entries) -> tuple[DataFrame, DataFrame]:
    """(files (root_id, rel_path, size, mtime), unread (root_id, rel_path)): all files below ``root`` but those in skipped
    or hidden folders, and the folders that could not be read ("" for the root itself).

    ``root`` is a path that all machines of the cluster see. Each level's folders are dealt to tasks, so a tree of many
    folders is listed by many, and a skipped folder costs nothing, whatever lies in it.
    """

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rel in frame["rel_path"]:
                out = []
                try:
                    for name, is_folder, size, mtime in list_folder(os.path.join(root, rel) if rel else root):
                        path = f"{rel}/{name}" if rel else name
                        if not is_folder:
                            out.append(("file", path, size, mtime))
                        elif _entered(name):
                            out.append(("folder", path, 0, 0.0))
                except OSError:
                    out.append(("unread", rel, 0, 0.0))  # what was seen before the error counts as seen
                yield pd.DataFrame(out, columns=["kind", "rel_path", "size", "mtime"])

    schema = "kind string, rel_path string, size long, mtime double"
    level = spark.createDataFrame([("",)], "rel_path string")
    levels = []
    while True:
        seen = materialise(level.mapInPandas(step, schema), "listing")
        levels.append(seen.where("kind <> 'folder'"))
        folders = seen.where("kind = 'folder'").select("rel_path")
        if not folders.limit(1).count():
            break
        level = folders.repartition("rel_path")
    every = levels[0]
    for more in levels[1:]:
        every = every.unionAll(more)
    files = every.where("kind = 'file'").select(F.lit(root_id).alias("root_id"), "rel_path", "size", "mtime")
    return files, every.where("kind = 'unread'").select(F.lit(root_id).alias("root_id"), "rel_path")
