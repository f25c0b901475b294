"""Directory walk: files by extension below a root. Symbolic links are neither followed nor listed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import errors
from ..functions.photo import EXTENSIONS, PRUNED

#: Directories that the driver lists before the rest is dealt out to executors.
FRONT = 256
SCHEMA = "kind string, path string, detail string"
FILE, VISITED, PRUNED_DIR, UNREADABLE = "file", "visited", "pruned", "unreadable"


def extension_of(name: str) -> str | None:
    stem, dot, last = name.rpartition(".")
    return last.lower() if dot and stem else None


def one_directory(path: str) -> tuple[list[tuple[str, str, str | None]], list[str]]:
    """What a directory has: rows of the listing, and its directories to visit."""
    rows, below = [], []
    try:
        with os.scandir(path) as found:
            for item in sorted(found, key=lambda e: e.name):
                if item.is_symlink():
                    continue
                if item.is_dir():
                    if item.name in PRUNED:
                        rows.append((PRUNED_DIR, item.path, None))
                    else:
                        below.append(item.path)
                elif item.is_file() and extension_of(item.name) in EXTENSIONS:
                    rows.append((FILE, item.path, None))
        rows.append((VISITED, path, None))
    except OSError as e:
        rows.append((UNREADABLE, path, str(e)))
    return rows, below


def walk(roots: list[str], most: int | None = None) -> tuple[list[tuple[str, str, str | None]], list[str]]:
    """Rows of all directories below; with most, stops once so many are still to visit and returns them."""
    rows, ahead = [], list(roots)
    while ahead and (most is None or len(ahead) < most):
        own, below = one_directory(ahead.pop(0))
        rows += own
        ahead += below
    return rows, ahead


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ahead = batch.column(0).to_pylist()
        while ahead:
            rows, below = one_directory(ahead.pop())
            ahead += below
            kind, path, detail = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(path, pa.string()), pa.array(detail, pa.string())], ["kind", "path", "detail"])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """kind (file, visited, pruned, unreadable), path, detail of everything below root.

    The driver walks until there are FRONT directories ahead; these subtrees are walked by the executors, which must
    see the same file system.
    """
    if not os.path.isdir(root):
        raise errors.TriageError(errors.SCAN_PATH, root, "not a directory")
    rows, ahead = walk([root], FRONT)
    listed = spark.createDataFrame(rows, SCHEMA)
    if not ahead:
        return listed
    subtrees = spark.createDataFrame([(p,) for p in ahead], "path string").repartition(len(ahead))
    return listed.unionByName(subtrees.mapInArrow(_walked, SCHEMA))


def files_of(listing: DataFrame) -> DataFrame:
    return listing.where(f"kind = '{FILE}'").select("path")


def counters(listing: DataFrame) -> DataFrame:
    """files, visited_dirs, pruned_dirs, unreadable_dirs: one row."""
    return listing.selectExpr(f"count_if(kind = '{FILE}') AS files", f"count_if(kind = '{VISITED}') AS visited_dirs", f"count_if(kind = '{PRUNED_DIR}') AS pruned_dirs", f"count_if(kind = '{UNREADABLE}') AS unreadable_dirs")
