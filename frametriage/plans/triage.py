"""The whole flow over a folder: list, decode, score, group, report."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from .. import errors
from ..operators import report, similarity
from ..settings import Settings
from ..sources import frames

DEFAULT_THRESHOLD = 8


@dataclasses.dataclass
class Scan:
    """Frames and skipped files of a folder. The files are read once: what was decoded is kept in the checkpoint folder."""

    root: str
    frames: DataFrame
    skipped: DataFrame

    def statistics(self) -> DataFrame:
        return report.statistics(self.frames, self.skipped)


def check_threshold(t: int) -> None:
    if not 0 <= t <= 64:
        raise errors.TriageError(errors.PARAMETER, "esik", "the distance must be from 0 to 64")


def scan(spark: SparkSession, root: str, settings: Settings | None = None, hashing: bool = True) -> Scan:
    """A broken file becomes a skipped row and never ends the scan."""
    settings = settings or Settings()
    if (problem := settings.problem()) is not None:
        raise errors.TriageError(errors.BAD_SETTINGS, "settings", problem)
    similarity.use_checkpoint_dir(spark)
    decoded = frames.read_files(spark, root, hashing).checkpoint()
    return Scan(root, frames.frames_of(decoded, settings, hashing), frames.skipped_of(decoded))


def items_of(own: DataFrame) -> DataFrame:
    """item (by order of path), hash of the frames that have one."""
    return similarity.dense_numbers(own, "path", "item").join(own.select("path", "hash"), "path").where("hash is not null").select("item", "hash")


def group(own: Scan, t: int = DEFAULT_THRESHOLD) -> DataFrame:
    check_threshold(t)
    return similarity.groups(items_of(own.frames), t)


def judge(own: Scan, t: int = DEFAULT_THRESHOLD, path: str | None = None) -> str:
    """The report as text, written to path if one is given."""
    check_threshold(t)
    return report.write_report(path, own.root, t, own.frames, own.skipped)
