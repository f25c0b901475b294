"""Perceptual hashes of 8 by 8 cells: DCT coefficients against their mean; distances and bands of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors

SIDE = 8
MARGIN = 1e-9
EMPTY = 0
#: Orthonormal DCT-II of 8 values: a row for each frequency.
DCT = np.where(np.arange(SIDE) == 0, 0.5**0.5, 1.0)[:, None] * 0.5 * np.cos((2 * np.arange(SIDE) + 1) * np.arange(SIDE)[:, None] * np.pi / 16)
#: The two-dimensional transform as one matrix, cells and coefficients row by row.
DCT_2D = np.kron(DCT, DCT)


def coefficients(cells: np.ndarray) -> np.ndarray:
    """Of each row of 64 cells."""
    return cells @ DCT_2D.T


def hashes(cells: np.ndarray) -> np.ndarray:
    """A bit for each coefficient over the mean of all but the first, whose bit is never set; the first is the highest bit."""
    own = coefficients(cells)[:, 1:]
    bits = np.pad(own > own.mean(axis=1, keepdims=True) + MARGIN, ((0, 0), (1, 0)))
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel() if len(cells) else np.zeros(0, np.int64)


def cells_of(image: np.ndarray) -> np.ndarray | None:
    """Means of 8 by 8 boxes with whole-pixel bounds; None for an image with a side under 8."""
    if min(image.shape) < SIDE:
        return None
    rows, columns = ([b * n // SIDE for b in range(SIDE + 1)] for n in image.shape)
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.float64), rows[:-1], axis=0), columns[:-1], axis=1)
    return (sums / np.outer(np.diff(rows), np.diff(columns))).ravel()


def hash_of(image: np.ndarray) -> int | None:
    cells = cells_of(image)
    return None if cells is None else int(hashes(cells[None])[0])


def strict_hash(image: np.ndarray) -> int:
    """hash_of, or an error for an image that is too small."""
    found = hash_of(image)
    if found is None:
        raise errors.TriageError(errors.BROKEN_PREVIEW, "image", f"{image.shape[1]}x{image.shape[0]} pixels, at least {SIDE}x{SIDE}")
    return found


def _cells(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows with 64 cells, and which they are."""
    lists = batch.column(column)
    good = np.array(pc.fill_null(pc.equal(pc.list_value_length(lists), SIDE * SIDE), False))
    flat = lists.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, SIDE * SIDE), good


def _append(name: str, kind: pa.DataType, column: str, compute, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, good = _cells(batch, column)
        values = iter(compute(cells))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([next(values) if g else None for g in good], kind)], [*batch.schema.names, name])


def with_hash(df: DataFrame, cells: str = "cells", name: str = "hash") -> DataFrame:
    """Adds the hash of the cells, one matrix product for each Arrow batch; null unless there are 64 cells."""
    return df.mapInArrow(lambda it: _append(name, pa.int64(), cells, hashes, it), T.StructType([*df.schema, T.StructField(name, T.LongType())]))


def with_coefficients(df: DataFrame, cells: str = "cells", name: str = "coefficients") -> DataFrame:
    return df.mapInArrow(lambda it: _append(name, pa.list_(pa.float64()), cells, coefficients, it), T.StructType([*df.schema, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hash_from_hex(text: Column) -> Column:
    """Null for what is not a number to base 16."""
    return F.when(text.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(text, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_bit(h: Column, i: int) -> Column:
    """From the highest one; false from 64 on."""
    return F.getbit(h, F.lit(63 - i)) == 1 if 0 <= i < 64 else F.lit(False)


def band(h: Column, k: int, width: int = 16) -> Column:
    """The k-th group of bits, from the lowest."""
    return F.shiftrightunsigned(h, width * k).bitwiseAND((1 << width) - 1)
