"""Shared by the training-data operators."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..operators.components import use_checkpoint_dir

#: What a worker's memo tables hold at most, by estimate; a full one is emptied and filled anew.
MEMO_BYTES = 48_000_000
#: Words of this length and more are not remembered.
LONG_WORD = 64
#: Rows of a batch whose texts are Python strings at the same time.
ROWS_AT_ONCE = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; a temporary folder only in local mode."""
    use_checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the folder that all executors share."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_numbers(start: int = 0) -> Iterator[int]:
    """Distinct over all tasks of a stage, the same again when a task is run again."""
    n = (TaskContext.get().partitionId() << 36) + start
    while True:
        yield n
        n += 1


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """Nulls count as empty. Only a part of the batch is held as strings at a time."""
    own = batch.column(column)
    for at in range(0, len(own), ROWS_AT_ONCE):
        for text in own.slice(at, ROWS_AT_ONCE).to_pylist():
            yield text or ""


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for what is made of each to be small too."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


_HELD: dict = {}


def held(key: tuple, build: Callable):
    """What build makes, kept by this worker between tasks until it needs another: one model and its memo tables at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def fold(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, modulo n."""
    return zlib.crc32(str(doc_id).encode()) % n


def byte_alphabet() -> dict[str, int]:
    """The bytes by the characters that stand for them in byte-level files: printable Latin-1 ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def single_threaded() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
