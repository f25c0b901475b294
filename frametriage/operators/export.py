"""Copies of the recommended files: plan, guard of the destination, safe copy. Copies only; nothing is moved or deleted."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from .components import use_checkpoint_dir

CHUNK = 64 * 1024
SUFFIX = ".gecici"
MOST_NAMES = 9999


def check_destination(root: str, destination: str) -> None:
    """Neither may hold the other; links and parent steps are resolved, letter case is passed over."""
    a, b = (Path(os.path.realpath(p).lower()) for p in (root, destination))
    if a == b or a in b.parents or b in a.parents:
        raise errors.TriageError(errors.DESTINATION, destination)


def unique_name(path: str) -> str:
    """The path, or the first of stem-2, stem-3 ... that does not exist; an error if none is free."""
    own = Path(path)
    names = (own if n == 1 else own.with_name(f"{own.stem}-{n}{own.suffix}") for n in range(1, MOST_NAMES + 1))
    free = next((p for p in names if not p.exists()), None)
    if free is None:
        raise errors.TriageError(errors.IO, path, "no free name")
    return str(free)


def copy_file(source: str, target: str) -> int:
    """Copies to a name beside the target, syncs and renames; the bytes copied. Nothing is left after a failure."""
    part = target + SUFFIX
    try:
        with open(source, "rb") as a, open(part, "wb") as b:
            shutil.copyfileobj(a, b, CHUNK)
            b.flush()
            os.fsync(b.fileno())
            n = b.tell()
        os.replace(part, target)
    except OSError as e:
        Path(part).unlink(missing_ok=True)
        raise errors.TriageError(errors.IO, source, str(e)) from e
    return n


def numbered_name(name: Column, number: Column) -> Column:
    """name for number 1, else stem-number with the extension."""
    stem, suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return F.when(number == 1, name).otherwise(F.concat(stem, F.lit("-"), number.cast("string"), suffix))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds number, from 1 for each file_name in order of group_id. A frequent name's rows are dealt over ranges, which are numbered apart and shifted."""
    use_checkpoint_dir(rows.sparkSession)
    spread = rows.repartitionByRange("file_name", "group_id").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = spread.groupBy("file_name", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("file_name", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("file_name", "part").orderBy("group_id", "path"))
    return spread.withColumn("own", own).join(shifts, ["file_name", "part"]).withColumn("number", F.col("own") + F.col("shift"))


def export_plan(recommended: DataFrame, only: int | None = None) -> DataFrame:
    """group_id, source, target name for group_id, path, file_name: equal names are numbered in order of group_id, then path."""
    rows = recommended if only is None else recommended.where(F.col("group_id") == only)
    rows = _numbered(rows.select("group_id", "path", "file_name"))
    return rows.select("group_id", F.col("path").alias("source"), numbered_name(F.col("file_name"), F.col("number")).alias("target"))


def export(report: dict, destination: str, only: int | None = None) -> list[tuple[int, str, int, float]]:
    """Copies each group's recommended file: group, target, bytes, first member's total. Stops at the first error; earlier copies stay."""
    check_destination(report["kok"], destination)
    try:
        os.makedirs(destination, exist_ok=True)
    except OSError as e:
        raise errors.TriageError(errors.IO, destination, str(e)) from e
    done = []
    for group in report["gruplar"]:
        if only is None or group["kimlik"] == only:
            target = unique_name(os.path.join(destination, os.path.basename(group["oneri"])))
            n = copy_file(group["oneri"], target)
            done.append((group["kimlik"], target, n, group["uyeler"][0]["toplam_puan"] if group["uyeler"] else 0.0))
    return done
