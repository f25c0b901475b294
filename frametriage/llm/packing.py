"""Packing of token sequences into bins of fixed size by best-two-fit.

Only lengths matter for the choice, and there are at most as many lengths as a bin holds. So the corpus is reduced to a
histogram of lengths, the plan is made on it (a bin's pattern is repeated while its lengths last, which gives the same
bins as going one by one), and each piece finds its bin from its rank among the pieces of its length. Ranks are counted
within shards of a length and shifted by the sizes of the shards before, so no length has to fit in a task.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_alphabet, cut, held, row_numbers, single_threaded, texts_of


#: Pre-tokens may be this long where the fast encoder is used, whose time grows with the square of their length.
LONG_RUN = 4096
#: The split pattern of the file's pre-tokenizer, and the same for texts without white space side by side.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


class ByteTokens:
    """Ids of the byte-level tokenizer file, with nothing remembered between texts.

    The file's vocabulary is given to a faster encoder, which merges by rank; that is the same if ids are ranks, as is
    asserted. Texts with special strings or with very long pre-tokens go to the library itself.
    """

    def __init__(self, path: str):
        single_threaded()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in file["added_tokens"]]
        split, model = file["pre_tokenizer"], file["model"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        assert file["normalizer"] is None and plain.items() <= split.items() and model["type"] == "BPE" and not model.get("ignore_merges"), "another kind of file"
        assert not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")), "another kind of file"
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = [ids[a + b] for a, b in model["merges"]]
        assert merged == sorted(set(merged)) and len(ids) == len(merged) + 256, "ids are not ranks"
        byte = byte_alphabet()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in ids.items()}
        self.encode = tiktoken.Encoding("any", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode_single = tiktoken.Encoding("single", pat_str=SPLIT_SINGLE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if any(s in text for s in self.special):
            return self.whole(text)
        blank = np.frombuffer(text.encode(), np.uint8) <= 32
        if len(blank) > LONG_RUN:
            ends = np.flatnonzero(blank[1:] != blank[:-1])
            if np.diff(ends, prepend=-1, append=len(blank) - 1).max() > LONG_RUN:
                return self.whole(text)
        double = (blank[1:] & blank[:-1]).any() if text.isascii() else DOUBLE.search(text)
        return array("I", (self.encode if double else self.encode_single)(text)).tobytes()


DOUBLE = re.compile(r"\s\s")


def byte_tokens(path: str) -> ByteTokens:
    return held(("byte tokens", path), lambda: ByteTokens(path))


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than size."""
    first = n if n <= size else n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def _pieces(path: str, size: int, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, last, ids = byte_tokens(path), np.array([end], "<u4").tobytes(), row_numbers()
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            own = tokens.ids(text) + last
            for k, (start, length) in enumerate(cuts(len(own) // 4, size)):
                out.append((next(ids), doc_id, k, start, length, zlib.crc32(own[4 * start : 4 * (start + length)])))
        names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def token_pieces(docs: DataFrame, path: str, *, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (distinct), doc_id, piece, start, length, ids_crc32: the documents' ids and the end id, cut to at most size."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(functools.partial(_pieces, path, size, end), "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many bins of each, from the number of pieces of each length.

    A bin takes the largest length that still fits until none does. If a gap is left, its smallest piece is taken out and
    the two unpacked ones put in that fill the larger gap best, if they fill it better than the smallest one did.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index, plan = np.arange(size + 1), []
    while left.any():
        rest, pattern, gap = left.copy(), [], size
        while gap:
            fits = np.flatnonzero(rest[: gap + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = min(int(rest[length]), gap // length)
            pattern += [length] * n
            rest[length] -= n
            gap -= n * length
        if gap and len(pattern) > 1:
            room = gap + pattern[-1]
            below = np.maximum.accumulate(np.where(rest > 0, index, 0))  # the largest unpacked length up to each
            first = np.flatnonzero(rest[:room])
            second = np.minimum(below[room - first], first)
            alone = (second == first) & (rest[first] < 2)
            second = np.where(alone, below[np.maximum(second - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > pattern[-1]:
                best = int(total.argmax())
                pattern = [*pattern[:-1], int(first[best]), int(second[best])]
        lengths, times = np.unique(pattern, return_counts=True)
        bins = int((left[lengths] // times).min())
        left[lengths] -= times * bins
        plan.append((sorted(pattern, reverse=True), bins))
    return plan


def _places(plan: list[tuple[list[int], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the first rank of each slot, and the slot's first bin and offset."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for pattern, bins in plan:
        offset = 0
        for length in pattern:
            at = used.get(length, 0)
            slots.setdefault(length, []).append((at, first_bin, offset))
            used[length] = at + bins
            offset += length
        first_bin += bins
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}


def _place(places, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = places.value
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for own in np.unique(length):
            at = length == own
            from_rank, first_bin, place = places[int(own)]
            slot = np.searchsorted(from_rank, rank[at], side="right") - 1
            sequence[at] = first_bin[slot] + rank[at] - from_rank[slot]
            offset[at] = place[slot]
        kept = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, *, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    Null texts count as empty and are one piece of the end id. Repeated rows are packed each; ids may be null. Other
    columns are not read. The histogram and the plan are bounded by size, not by the number of documents.
    """
    pieces = cut(token_pieces(docs, path, size=size, end=end, id_col=id_col, text_col=text_col))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(_places(best_two_fit(counts, size), size))
    shards = 64 + sum(counts.values()) // shard_rows
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    sizes = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "shard").orderBy("row")))
    ranked = ranked.join(bases, ["length", "shard"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(functools.partial(_place, places), schema)
