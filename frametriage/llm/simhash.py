"""SimHash fingerprints and near-duplicate groups through Golay-code keys.

Two fingerprints within 3 of 64 bits, cut into four 16-bit segments, agree fully in one segment, and for some such
segment the next one (cyclically) differs in at most 2 bits: of three errors outside segments without any, all three
can be in the segment that follows one of them only if another error-free segment is followed by an error-free one.

The perfect binary Golay code (23, 12, 7) gives the tolerance: every 23-bit word is within 3 bits of exactly one
codeword. A segment's keys are the indices of the codewords nearest to it and to its one-bit neighbours. Segments that
differ in at most 2 bits have a common neighbour and so share a key. A fingerprint has up to four times six keys of
(segment number, exact segment, codeword index); those that share one are candidates, and all are verified.

These are 2^30 keys. Where one holds too many fingerprints to compare, its bucket is dealt anew by a second level: of the
two segments left one has at most 1 error, so two that link share a codeword index of the third or the fourth segment.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..operators.skew import join_back, unused
from .common import cut, texts_of

SEED = 42
#: Fingerprints that are compared with each other in one bucket; larger ones are dealt anew, then go by common neighbours.
BUCKET = 2048
#: Generator polynomial of the binary Golay code.
GOLAY = 0b110001110101
BLOCK = 1 << 16


def shingle_hashes(text: str, size: int = 3) -> Iterator[np.ndarray]:
    """Blocks of XXH64 of word shingles, A-Z in lower case; a text of fewer words is one shingle."""
    words = text.encode().lower().split()
    n = max(len(words) - size + 1, 1 if words else 0)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(min(size, len(words)))), strict=False)) if words else iter(())
    for at in range(0, n, BLOCK):
        count = min(BLOCK, n - at)
        yield np.fromiter(map(xxhash.xxh64_intdigest, itertools.islice(shingles, count), itertools.repeat(SEED)), np.uint64, count)


def fingerprint(text: str, size: int = 3) -> int:
    """A bit is set if it is in over half of the hashes; 0 for a text without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, size):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t, size) for t in texts_of(batch)], pa.int64())], ["doc_id", "fp"])


@functools.cache
def segment_keys() -> np.ndarray:
    """For each 16-bit segment its codeword indices, padded with the first of them."""

    def remainder(v: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            v = np.where(v >> bit & 1, v ^ (GOLAY << (bit - 11)), v)
        return v

    errors = np.array([sum(1 << b for b in bits) for k in range(4) for bits in itertools.combinations(range(23), k)])
    nearest = np.zeros(2048, np.int64)
    nearest[remainder(errors)] = errors
    words = np.arange(1 << 16, dtype=np.int64) << 7
    near = np.stack([words, *(words ^ (1 << b) for b in range(7, 23))], axis=1)
    index = np.sort((near ^ nearest[remainder(near)]) >> 11, axis=1)
    keep = np.ones(index.shape, bool)
    keep[:, 1:] = index[:, 1:] != index[:, :-1]
    width = keep.sum(axis=1).max()
    order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
    return np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(index, order, 1), index[:, :1]).astype(np.int64)


def fingerprint_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the position of each one's fingerprint."""
    table, u, keys, rows = segment_keys(), fp.view(np.uint64), [], []
    segment = [(u >> np.uint64(16 * s) & np.uint64(0xFFFF)).astype(np.int64) for s in range(4)]
    for s in range(4):
        own = table[segment[(s + 1) % 4]]
        fresh = np.ones(own.shape, bool)
        fresh[:, 1:] = own[:, 1:] != own[:, :1]
        keys.append((own | segment[s][:, None] << 12 | s << 28)[fresh])
        rows.append(np.nonzero(fresh)[0])
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        keys, rows = fingerprint_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])


def refined_keys(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For members of buckets their keys of the second level, and the position of each one's member."""
    table, u, keys, rows = segment_keys(), fp.view(np.uint64), [], []
    for j in (2, 3):
        shift = (16 * ((key >> 28) + j & 3)).astype(np.uint64)
        own = table[(u >> shift & np.uint64(0xFFFF)).astype(np.int64)]
        fresh = np.ones(own.shape, bool)
        fresh[:, 1:] = own[:, 1:] != own[:, :1]
        keys.append((own | (j & 1) << 12 | key[:, None] << 13)[fresh])
        rows.append(np.nonzero(fresh)[0])
    return np.concatenate(keys), np.concatenate(rows)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        keys, rows = refined_keys(batch.column("key").to_numpy(), fp)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])


def forest(fps: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Links within the distance that join up each component of a bucket: one less than its members."""
    rest = np.array(fps, np.int64)
    while len(rest):
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            at = ahead.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= most
            if near.any():
                found = rest[near]
                rest = rest[~near]
                ahead += list(found)
                for x in found.tolist():
                    yield int(at), x


def _links(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's fingerprints are at most BUCKET."""
    key, members, a, b = None, [], [], []

    def close() -> None:
        if len(members) == 2:
            if ((members[0] ^ members[1]) & (1 << 64) - 1).bit_count() <= most:
                a.append(members[0]), b.append(members[1])
        elif len(members) > 2:
            for x, y in forest(members, most):
                a.append(x), b.append(y)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for k, fp in zip(batch.column("key").to_pylist(), batch.column("fp").to_pylist(), strict=True):
            if k != key:
                close()
                key, members = k, []
            members.append(fp)
        yield out()
        a, b = [], []
    close()
    yield out()


@functools.cache
def _around() -> tuple[np.ndarray, np.ndarray]:
    """Patterns of up to 1 bit, and of 2 bits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([[np.uint64(0)], one]).astype(np.uint64), one[i] | one[j]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    near, far = _around()
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fp), 64):
            part = fp[at : at + 64]
            word = np.concatenate([(part[:, None] ^ near).ravel(), (part[:, None] ^ far).ravel()])
            own = np.concatenate([np.repeat(part, len(near)), np.repeat(part, len(far))])
            close = np.repeat([True, False], [len(part) * len(near), len(part) * len(far)])
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(own.view(np.int64)), pa.array(close)], ["word", "fp", "near"])


def neighbour_links(fps: DataFrame) -> DataFrame:
    """Links that join up all fingerprints within 3 bits, in a number of rows linear in their number.

    Two of them have a word within 1 bit of one and 2 of the other. Around a word, everything is within 3 bits of
    what is within 1 bit of it: all link to the smallest such one. A word has at most 2081 fingerprints around it.
    """
    around = fps.mapInArrow(_neighbours, "word long, fp long, near boolean")
    stars = around.groupBy("word").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all"))
    return stars.where("a is not null and size(all) > 1").select("a", F.explode("all").alias("b")).where("a != b").distinct()


def _bucket_links(keyed: DataFrame, most: int, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """Links within the buckets of at most `bucket` fingerprints; key, fp of the larger ones, if there are any."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(join_back(keyed, counts, ["key"]).select("key", "fp", "n"))
    cold = shared.where(F.col("n") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key")
    hot = shared.where(F.col("n") > bucket).select("key", "fp")
    return cold.mapInArrow(functools.partial(_links, most), "a long, b long"), None if hot.isEmpty() else hot


def fingerprint_links(fps: DataFrame, most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """a, b: links (within `most` <= 3 bits) between distinct fingerprints, enough to join up every group of them."""
    links, hot = _bucket_links(fps.select("fp").mapInArrow(_keys, "key long, fp long"), most, bucket)
    if hot is not None:
        more, hot = _bucket_links(hot.mapInArrow(_refined, "key long, fp long"), most, bucket)
        links = links.unionByName(more)
    if hot is not None:
        more = neighbour_links(hot.select("fp").distinct())
        if most < 3:
            more = more.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
        links = links.unionByName(more)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id, fp for each row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(texts.mapInArrow(functools.partial(_fingerprints, size), "doc_id long, fp long"))


def fingerprint_classes(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """fp, root (one fingerprint for each group), component_id for each distinct fingerprint."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(classes, bucket=bucket)).select(F.col("node").alias("fp"), "root")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return join_back(classes.select("fp", "root"), smallest, ["root"]).select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id that can be reached. Null texts
    and texts without words have fingerprint zero, linked like any other. Rows are kept apart even if they repeat; a null
    doc_id is kept and is nobody's smallest unless a group has no other. Other columns are not read, an empty table gives
    an empty one. No bound drops a link: buckets over `bucket` fingerprints are dealt anew, then linked by common neighbours.
    """
    fps = fingerprints(docs, id_col=id_col, text_col=text_col, size=size)
    named = fps.join(fingerprint_classes(fps, bucket), "fp")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_fingerprint(size: int, column: str, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = pa.array([fingerprint(t, size) for t in texts_of(batch, column)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, fps], [*batch.schema.names, name])


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Of each group of simhash_groups one row, with all columns of docs, whatever their names: the one with the smallest id.

    Where ids repeat, it is among the rows with the group's smallest id the one with the smallest (signed) fingerprint, then
    with the smallest text, a null one first, then with the smallest hash of its other columns; of rows that are alike in
    all this, one. Ids that are null come after all others. An empty table stays empty.
    """
    fps = fingerprints(docs, id_col=id_col, text_col=text_col, size=size)
    classes = fingerprint_classes(fps)
    own, head = F.col(f"`{id_col}`").cast("long"), unused(docs, "head")
    if fps.groupBy("doc_id").count().where("count > 1").isEmpty():
        heads = classes.select(F.col("component_id").alias(head)).distinct()
        return docs.join(heads, own.eqNullSafe(F.col(head)), "left_semi")
    name = unused(docs, "fp")
    rows = docs.mapInArrow(functools.partial(_with_fingerprint, size, text_col, name), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    rest = [F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.MapType | T.VariantType) else F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col)]
    order = F.struct(F.col(name), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.lit(0), *rest))
    packed = rows.select(own.alias("id"), F.col(name).alias("fp"), order.alias("order"), F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("row"))
    named = packed.join(classes.select("fp", "root", "component_id"), "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    found = named.groupBy("root").agg(F.min_by("row", "order").alias("row"))
    return found.select(*(F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)))
