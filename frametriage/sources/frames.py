"""From files to frames: ranged reads in Python on the executors, metadata and score as columns.

A task takes paths (or rows with the file's bytes), reads header, directories, wanted values and the preview, and gives
one row for each file: a frame, or a label of what is wrong. Pixels never leave the task.
"""

from __future__ import annotations

import functools
import io
import os
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import errors, schemas
from ..functions import photo
from ..functions.phash import hash_of
from ..functions.score import score_struct
from ..operators.components import use_checkpoint_dir
from ..settings import Settings
from . import listing
from .jpeg import JpegError, luma
from .tiff import FIELDS, TiffFile

MOST_PREVIEW = 24 << 20
FILES_A_TASK = 200
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "float": pa.float32()}
COLUMNS = {name: _ARROW[kind] for name, kind in (c.split() for c in schemas.DECODED.split(", "))}


def decode(path: str, content: bytes | None = None, hashing: bool = True) -> dict:
    """A row of schemas.DECODED. Without hashing the preview is not looked for. A broken preview leaves the hash null."""
    row = dict.fromkeys(COLUMNS) | {"path": path, "file_name": path.rsplit("/", 1)[-1]}
    try:
        with io.BytesIO(content) if content is not None else open(path, "rb") as file:
            tiff = TiffFile(file, path)
            tiff.load()
            row |= tiff.metadata()
            if hashing:
                row |= preview_of(tiff)
            row |= {"file_size": tiff.size, "bytes_read": tiff.bytes_read}
    except errors.TriageError as e:
        row |= {"error": e.label, "detail": str(e)}
    except OSError as e:
        row |= {"error": errors.IO, "detail": str(e)}
    return row


def preview_of(tiff: TiffFile) -> dict:
    try:
        found = tiff.preview()
        if found is None:
            return {}
        offset, length, source = found
        row = {"preview_offset": offset, "preview_bytes": length, "preview_source": source}
        if length > MOST_PREVIEW:
            return row
        return row | {"hash": hash_of(luma(tiff.read(offset, length)))}
    except errors.TriageError:
        return {}
    except JpegError:
        return row


def read_stream(source: BinaryIO, n: int, name: str) -> bytes:
    """Exactly n bytes of a preview from a stream that may give fewer at a time; an error if it ends before or fails."""
    out = bytearray()
    try:
        while len(out) < n and (part := source.read(n - len(out))):
            out += part
    except OSError as e:
        raise errors.TriageError(errors.BROKEN_PREVIEW, name, str(e)) from e
    if len(out) < n:
        raise errors.TriageError(errors.BROKEN_PREVIEW, name, f"{n} bytes expected, {len(out)} read")
    return bytes(out)


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in COLUMNS.items()], list(COLUMNS))


def _decoded(hashing: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = batch.column("content").to_pylist() if "content" in batch.schema.names else [None] * len(batch)
        yield to_batch([decode(p, c, hashing) for p, c in zip(batch.column("path").to_pylist(), contents, strict=True)])


def decode_files(files: DataFrame, hashing: bool = True) -> DataFrame:
    """schemas.DECODED for each row of path, or of path and content."""
    return files.select("path", *(["content"] if "content" in files.columns else [])).mapInArrow(functools.partial(_decoded, hashing), schemas.DECODED)


def frames_of(decoded: DataFrame, settings: Settings | None = None, hashing: bool = True) -> DataFrame:
    """Frames with metadata and score, all in columns."""
    settings = settings or Settings()
    c = F.col
    aspect = photo.aspect(c("width"), c("height"), c("orientation"))
    meta = F.struct(
        "make",
        "model",
        photo.capture_time(c("capture_raw")).alias("capture_time"),
        *("exposure_s", "f_number", "iso", "focal_mm", "orientation", "width", "height"),
        aspect.alias("aspect"),
        photo.crop_factor(c("width"), c("height"), c("focal_mm")).alias("crop_factor"),
    )
    score = score_struct(c("exposure_s"), c("focal_mm"), c("iso"), aspect, c("orientation"), c("exposure_bias"), settings)
    seen = c("preview_bytes").isNotNull() if hashing else F.lit(False)
    return decoded.where("error is null").select("path", "file_name", "file_size", "bytes_read", "hash", seen.alias("has_preview"), "preview_bytes", meta.alias("meta"), score.alias("score"))


def skipped_of(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is not null").select("path", "error", "detail")


def read_files(spark: SparkSession, root: str, hashing: bool = True) -> DataFrame:
    """schemas.DECODED for all accepted files below root. Paths are dealt out evenly, so that no task waits for one large folder."""
    use_checkpoint_dir(spark)
    files = listing.files_of(listing.list_tree(spark, root)).checkpoint()  # the tree is walked once
    tasks = max(1, min(spark.sparkContext.defaultParallelism * 8, -(-files.count() // FILES_A_TASK)))
    return decode_files(files.repartition(tasks), hashing)


class _Paths(InputPartition):
    """Files, or a folder of which all files below are read."""

    def __init__(self, paths: list[str], below: str | None = None):
        super().__init__(paths)
        self.paths, self.below = paths, below


def _files(rows: list[tuple[str, str, str | None]]) -> list[str]:
    return [path for kind, path, _ in rows if kind == listing.FILE]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path", "")
        self.hashing = str(options.get("hashing", "true")).lower() == "true"

    def partitions(self):
        """The first folders are listed here, the folders below them by the tasks."""
        if not os.path.isdir(self.root):
            raise errors.TriageError(errors.SCAN_PATH, self.root, "not a directory")
        rows, ahead = listing.walk([self.root], listing.FRONT)
        files = _files(rows)
        near = [_Paths(files[i : i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)]
        return near + [_Paths([], folder) for folder in ahead] or [_Paths([])]

    def read(self, partition):
        yield to_batch([decode(p, None, self.hashing) for p in partition.paths])
        ahead = [partition.below] if partition.below else []
        while ahead:
            rows, folders = listing.one_directory(ahead.pop())
            ahead += folders
            if files := _files(rows):
                yield to_batch([decode(p, None, self.hashing) for p in files])


class FrameFiles(DataSource):
    """spark.dataSource.register(FrameFiles); spark.read.format("frames").option("path", root).load()"""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return schemas.DECODED

    def reader(self, schema):
        return _Reader(self.options)


def brightness(image: np.ndarray) -> float:
    """Mean of all pixels, 0 without any."""
    return float(image.mean()) if image.size else 0.0


def pixel(image: np.ndarray, x: int, y: int) -> int:
    """0 outside of the image."""
    height, width = image.shape
    return int(image[y, x]) if 0 <= x < width and 0 <= y < height else 0
