"""Sinks that write files: exports and backups that are carried out, each file staged, checked and then put in place.

A task that fails leaves at most staged files, which nobody reads and its retry replaces; what is in place is whole. A
second run finds equal files and writes nothing. Targets are paths that all machines of the cluster see.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactsheet.sources.export import backup_plan
from contactsheet.storage import materialise

_STEP = 1 << 20


def local_path(folder: str) -> str:
    """The path of a folder given as a path or as file:, which tasks can open; another store is refused."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"files are written to a shared path, not to {folder}")
    return folder


def _digest(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(_STEP):
            found.update(part)
    return found.hexdigest()


def _inside(root: str, rel: str) -> str | None:
    """The path below ``root``, or None for one that would leave it."""
    path = os.path.normpath(os.path.join(root, rel))
    return path if rel and path.startswith(os.path.join(root, "")) else None


def _put(path: str, parts: Callable[[], Iterator[bytes]], mtime: float | None = None) -> tuple[int, str]:
    """(bytes, sha256) of the file put in place: written beside its place, read back, then renamed."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    staged = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}.part")
    size, digest = 0, hashlib.sha256()
    try:
        with open(staged, "wb") as f:
            for part in parts():
                f.write(part)
                digest.update(part)
                size += len(part)
            f.flush()
            os.fsync(f.fileno())
        if _digest(staged) != digest.hexdigest():
            raise OSError(f"{path}: what was written reads differently")
        if mtime is not None:
            os.utime(staged, (mtime, mtime))
        os.replace(staged, path)
    except BaseException:
        if os.path.exists(staged):
            os.remove(staged)
        raise
    return size, digest.hexdigest()


def export_files(rows: DataFrame, target: str, *, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """K7: (path, bytes, sha256, action), written once: every row's content as a file below ``target``.

    ``action`` is copied, equal (such a file was there), or refused (an empty path, or one that leaves the target). Content is
    binary, or text written as UTF-8; a null is an empty file. Paths do not repeat (``free_name`` makes them so).
    """
    root = os.path.normpath(local_path(target))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rel, content in zip(frame["path"], frame["content"], strict=True):
                body = b"" if content is None else bytes(content)
                digest = hashlib.sha256(body).hexdigest()
                path = _inside(root, rel or "")
                if path is None:
                    out.append((rel, len(body), digest, "refused"))
                elif os.path.isfile(path) and os.path.getsize(path) == len(body) and _digest(path) == digest:
                    out.append((rel, len(body), digest, "equal"))
                else:
                    out.append((rel, *_put(path, lambda body=body: iter([body])), "copied"))
            yield pd.DataFrame(out, columns=["path", "bytes", "sha256", "action"])

    asked = rows.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    return materialise(asked.mapInPandas(run, "path string, bytes long, sha256 string, action string"), "exported")


def run_backup(files: DataFrame, source: str, target: str, there: DataFrame, *, slack: float = 2.0) -> DataFrame:
    """(rel_path, action, bytes, sha256), written once: ``backup_plan`` carried out. Files to copy are copied from
    ``source`` to ``target`` with their times; of one that cannot be read the action is failed and the others go on. Nothing
    is deleted. ``files`` and ``there`` (rel_path, size, mtime): what the source has and what the target has."""
    plan = backup_plan(files, there, slack=slack).join(files.select("rel_path", "mtime"), "rel_path")
    read, root = os.path.normpath(local_path(source)), os.path.normpath(local_path(target))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for rel, action, mtime in zip(frame["rel_path"], frame["action"], frame["mtime"], strict=True):
                size, digest = None, None
                path, origin = _inside(root, rel), _inside(read, rel)
                if action == "copy":

                    def parts(origin=origin) -> Iterator[bytes]:
                        with open(origin, "rb") as f:
                            while part := f.read(_STEP):
                                yield part

                    try:
                        if path is None or origin is None:
                            raise OSError(rel)
                        size, digest = _put(path, parts, mtime)
                        action = "copied"
                    except OSError:
                        action = "failed"
                out.append((rel, action, size, digest))
            yield pd.DataFrame(out, columns=["rel_path", "action", "bytes", "sha256"]).astype({"bytes": "Int64"})

    dealt = plan.select("rel_path", "action", "mtime").repartition("rel_path")
    return materialise(dealt.mapInPandas(run, "rel_path string, action string, bytes long, sha256 string"), "backup")
