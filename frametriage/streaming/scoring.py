"""Decoding and scoring of arriving files. Both look at one file at a time, so they run on a stream unchanged; grouping does not."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..settings import Settings
from ..sources.frames import decode_files, frames_of


def scored_stream(arriving: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Frames for a stream of path (or of path and content, as the binaryFile source gives)."""
    return frames_of(decode_files(arriving), settings)
