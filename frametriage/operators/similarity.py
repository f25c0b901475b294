"""Hamming similarity join, groups, conflicts, diameters of hashed items.

items: item (its place in scan order, distinct) and hash. A pair is similar if its hashes differ in at most t of 64 bits.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phash import hamming
from .components import connected_components, use_checkpoint_dir
from .skew import join_back

#: Distinct hashes that are broadcast at most (16 bytes each); more go through bands or blocks.
BROADCAST_ROWS = 20_000
#: Rows of a block of the grid join, and of the grid of a group.
BLOCK_ROWS = 8_192
GROUP_ROWS = 8_192
#: Pairs of two blocks that are compared at a time, and rows that are returned at a time at least.
CELLS = 1 << 17
RETURNED_ROWS = 1 << 16
#: Pairs that blocks compare in the time of one candidate of the bands.
PAIRS_A_CANDIDATE = 30


def _threshold(t: int) -> int:
    return min(t, 64)


def band_plan(t: int) -> tuple[int, int]:
    """Bands and the errors allowed in one: by the pigeonhole some band of a similar pair has that many at most."""
    bands = t + 1 if t < 4 else 4 if t < 12 else 0
    return bands, t // bands if bands else 0


def _near(b: int, value: Column):
    return lambda mask: F.struct(F.lit(b).alias("band"), value.bitwiseXOR(mask.cast("long")).alias("value"))


def band_keys(h: Column, bands: int, errors: int) -> Column:
    """array<struct<band, value>>: of each band all values within the errors."""
    keys = []
    for b in range(bands):
        low, high = 64 * b // bands, 64 * (b + 1) // bands
        value = F.shiftrightunsigned(h, low).bitwiseAND((1 << (high - low)) - 1) if high - low < 64 else h
        masks = [sum(1 << i for i in own) for k in range(errors + 1) for own in itertools.combinations(range(high - low), k)]
        keys.append(F.transform(F.array(*map(F.lit, masks)), _near(b, value)))
    return F.flatten(F.array(*keys))


def _banded(left: DataFrame, t: int) -> DataFrame:
    """Pairs of distinct hashes a < b by an equi-join on bands; exact for t under 12."""
    bands, errors = band_plan(t)
    one = left.select(F.col("hash").alias("a"), F.explode(band_keys(F.col("hash"), bands, 0)).alias("k")).select("a", "k.*")
    near = left.select(F.col("hash").alias("b"), F.explode(band_keys(F.col("hash"), bands, errors)).alias("k")).select("b", "k.*")
    joined = one.join(near.hint("merge"), ["band", "value"])
    return joined.where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= t)).select("a", "b").distinct()


def band_candidates(left: DataFrame, t: int) -> int:
    """A bound on the rows that _banded makes: its near keys, and for each of a value's masks at most the sum of squares of the values' counts."""
    bands, errors = band_plan(t)
    counts = left.select(F.explode(band_keys(F.col("hash"), bands, 0)).alias("k")).groupBy("k").agg(F.count("*").cast("double").alias("n"))
    masks = F.lit(float(sum(1 for k in range(errors + 1) for _ in itertools.combinations(range(64 // bands), k))))
    return int(counts.agg(F.coalesce(F.sum(masks * (F.col("n") + F.col("n") * F.col("n"))), F.lit(0.0))).first()[0])


def _paired(dealt: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """keys, pair: the rows of two blocks, or of one with itself, of equal keys. Each block goes to the tasks of its row and column of a triangular grid.

    dealt: keys, values, side (of the keys' grid) and block (under side). The number of tasks is fixed, since a few MB can stand for many pairs.
    """
    spark, block = dealt.sparkSession, F.col("block")
    last = (F.col("side") - 1).cast("long")
    blocks = dealt.groupBy(*keys, "side", "block").agg(F.collect_list(F.struct(*values)).alias("rows"))
    row = F.transform(F.sequence(block, last), lambda j: F.struct(block.alias("i"), j.alias("j")))
    column = F.transform(F.sequence(F.lit(0).cast("long"), block), lambda i: F.struct(i.alias("i"), block.alias("j")))
    placed = blocks.select(*keys, F.explode(F.array_union(row, column)).alias("at"), "rows").select(*keys, "at.*", "rows")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = placed.repartition(tasks, *keys, "i", "j").groupBy(*keys, "i", "j").agg(F.collect_list("rows").alias("pair"))
    return met.where("i = j OR size(pair) = 2").select(*keys, "pair")  # a block may have no rows


def _pairs_of(batches: Iterator[pa.RecordBatch], *values: str) -> Iterator[tuple]:
    """The keys, the values' arrays of one block and of the other, and whether they are the same block."""
    for batch in batches:
        keys, pairs = batch.columns[:-1], batch.columns[-1]
        for k in range(len(batch)):
            blocks = [x.values for x in pairs[k].values]
            sides = [[b.field(v).to_numpy(zero_copy_only=False) for v in values] for b in blocks]
            yield [c[k].as_py() for c in keys], sides[0], sides[-1], len(sides) == 1


def _distances(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """First rows of x and of y, and distances of some rows of x to all of y from there on. With the same block, pairs under the diagonal come twice."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    step = max(1, CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        start = at if same else 0
        yield at, start, np.bitwise_count(x[at : at + step, None] ^ y[start:])


def _chosen(x: np.ndarray, y: np.ndarray, same: bool, test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and in y of the pairs whose distance passes the test, each pair once, and the distances."""
    for at, start, d in _distances(x, y, same):
        found = np.flatnonzero(test(d))
        i, j = np.divmod(found, d.shape[1])
        if same:
            once = j > i
            found, i, j = found[once], i[once], j[once]
        if len(found):
            yield at + i, start + j, d.ravel()[found]


def _near_pairs(t: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held, n = [], 0
    for _, (x,), (y,), same in _pairs_of(batches, "hash"):
        for i, j, _ in _chosen(x, y, same, lambda d: d <= t):
            held.append((x[i], y[j]))
            n += len(i)
            if n >= RETURNED_ROWS:
                yield made()
                held, n = [], 0
    if held:
        yield made()


def _grid(left: DataFrame, n: int, t: int) -> DataFrame:
    """Similar pairs among all pairs of hashes, in blocks."""
    side = F.lit(-(-n // BLOCK_ROWS)).cast("long")
    dealt = left.select("hash", side.alias("side"), F.pmod(F.xxhash64("hash"), side).alias("block"))
    return _paired(dealt, [], "hash").mapInArrow(functools.partial(_near_pairs, t), "a long, b long")


def hash_pairs(hashes: DataFrame, t: int) -> DataFrame:
    """a < b: similar pairs of the distinct values of the column hash. Always exact; the size, and for bands how often their values repeat, pick the way."""
    t = _threshold(t)
    use_checkpoint_dir(hashes.sparkSession)
    distinct = hashes.select("hash").where("hash is not null").distinct().checkpoint()
    n = distinct.count()
    if n > BROADCAST_ROWS:
        banded = band_plan(t)[0] and band_candidates(distinct, t) * PAIRS_A_CANDIDATE < n * (n - 1) // 2
        return _banded(distinct, t) if banded else _grid(distinct, n, t)
    a, b = F.col("a"), F.col("b")
    right = F.broadcast(distinct.withColumnRenamed("hash", "b"))
    return distinct.withColumnRenamed("hash", "a").join(right, (a < b) & (hamming(a, b) <= t))


def similar_pairs(items: DataFrame, t: int) -> DataFrame:
    """first < second, distance: all similar pairs of items."""
    pairs = hash_pairs(items, t)
    a, b = items.select(F.col("item").alias("x"), F.col("hash").alias("a")), items.select(F.col("item").alias("y"), F.col("hash").alias("b"))
    unlike = pairs.join(a, "a").join(b, "b").select("x", "y", hamming(F.col("a"), F.col("b")).alias("distance"))
    alike = a.join(b.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y", F.lit(0).alias("distance"))
    both = unlike.unionByName(alike)
    return both.select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"), "distance")


def _classes(items: DataFrame) -> DataFrame:
    """hash, n: the distinct hashes and how many items have each."""
    return items.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"))


def pair_histogram(items: DataFrame, t: int) -> DataFrame:
    """distance, pairs: the number of similar pairs of items, counted by classes of equal hashes without making the pairs."""
    a, b = (_classes(items).select(F.col("hash").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    unlike = hash_pairs(items, t).join(a, "a").join(b, "b").select(hamming(F.col("a"), F.col("b")).alias("distance"), (F.col("n_a") * F.col("n_b")).alias("n"))
    alike = _classes(items).where("n > 1").select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("n"))
    return unlike.unionByName(alike).groupBy("distance").agg(F.sum("n").alias("pairs"))


def pair_counters(items: DataFrame, t: int) -> DataFrame:
    """total_pairs (compared in the sense of the exact join), candidate_pairs (similar). One row."""
    n = _classes(items).select("n", F.lit(0).cast("long").alias("pairs"))
    found = pair_histogram(items, t).select(F.lit(0).cast("long").alias("n"), "pairs")
    total, pairs = (F.coalesce(F.sum(x), F.lit(0).cast("long")) for x in ("n", "pairs"))
    sums = n.unionByName(found).agg(total.alias("n"), pairs.alias("candidate_pairs"))
    return sums.select(F.expr("n * (n - 1) div 2").alias("total_pairs"), "candidate_pairs")


def dense_numbers(df: DataFrame, column: str, name: str) -> DataFrame:
    """Numbers the distinct values of a column from 0 in their order, without a task that holds them all.

    Values are range-partitioned; each partition counts its own and is shifted by the sizes of those before.
    """
    use_checkpoint_dir(df.sparkSession)
    spread = df.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return spread.withColumn("_own", own).join(shifts, "_part").select(column, (F.col("_shift") + F.col("_own") - 1).alias(name))


def groups(items: DataFrame, t: int) -> DataFrame:
    """item, hash, group_id: the components of similarity, numbered from 0 by their smallest items.

    Items without hash are left out. Equal hashes are collapsed first, so that a burst of equal frames has no edges.
    """
    hashed = items.where("hash is not null").select("item", "hash")
    roots = connected_components(hash_pairs(hashed, t)).withColumnRenamed("node", "hash")
    classes = hashed.groupBy("hash").agg(F.min("item").alias("least")).join(roots, "hash", "left")
    classes = classes.withColumn("root", F.coalesce("root", "hash"))
    firsts = classes.groupBy("root").agg(F.min("least").alias("first"))
    named = firsts.join(dense_numbers(firsts, "first", "group_id"), "first").select("root", "group_id")
    return hashed.join(classes.select("hash", "root").join(named, "root").select("hash", "group_id"), "hash").select("item", "hash", "group_id")


def _inner_blocks(own: DataFrame, *values: str) -> DataFrame:
    """group_id, pair: blocks of the rows of each group that has two or more. A large group's are dealt over a grid of its own."""
    sides = own.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id", F.ceil(F.col("n") / GROUP_ROWS).alias("side"))
    dealt = join_back(own, sides, ["group_id"]).withColumn("block", F.pmod(F.xxhash64(values[-1]), F.col("side")))
    return _paired(dealt, ["group_id"], *values)


def _far(t: int, x: np.ndarray, y: np.ndarray) -> bool:
    return any(d.max(initial=0) > t for _, _, d in _distances(x, y, False))


def _far_pairs(t: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (group,), (x, p), (y, q), same in _pairs_of(batches, "hash", "item"):
        if not _far(t, np.unique(x), np.unique(y)):  # copies alone are not compared one by one
            continue
        for i, j, d in _chosen(x, y, same, lambda d: d > t):
            a, b = p[i], q[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), group, np.int64)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], ["group_id", "first", "second", "distance"])


def _far_groups(t: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (group,), (x,), (y,), _ in _pairs_of(batches, "hash"):
        if _far(t, x, y):
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64())], ["group_id"])


def _most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (group,), (x,), (y,), same in _pairs_of(batches, "hash"):
        most = max(int(d.max(initial=0)) for _, _, d in _distances(x, y, same))
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([most], pa.int32())], ["group_id", "most"])


def conflicts(membership: DataFrame, t: int) -> DataFrame:
    """group_id, first < second, distance, threshold: items of a group that are not similar themselves. As many rows as there are such pairs."""
    t = _threshold(t)
    items = membership.select(F.col("group_id").cast("long").alias("group_id"), "hash", F.col("item").cast("long").alias("item"))
    found = _inner_blocks(items, "hash", "item").mapInArrow(functools.partial(_far_pairs, t), "group_id long, first long, second long, distance int")
    return found.withColumn("threshold", F.lit(t))


def _inner_hashes(membership: DataFrame) -> DataFrame:
    return _inner_blocks(membership.select(F.col("group_id").cast("long").alias("group_id"), "hash").distinct(), "hash")


def conflicted(membership: DataFrame, t: int) -> DataFrame:
    """group_id of the groups with a conflict, without making the conflicts; two blocks are compared until there is one."""
    return _inner_hashes(membership).mapInArrow(functools.partial(_far_groups, _threshold(t)), "group_id long").distinct()


def diameters(membership: DataFrame) -> DataFrame:
    """group_id, diameter: the largest distance in each group, 0 for one of a single hash. A group is conflicted if it is over the threshold."""
    most = _inner_hashes(membership).mapInArrow(_most, "group_id long, most int").groupBy("group_id").agg(F.max("most").alias("most"))
    return membership.select("group_id").distinct().join(most, "group_id", "left").select("group_id", F.coalesce("most", F.lit(0)).alias("diameter"))


def conflicted_groups(found: DataFrame) -> DataFrame:
    """Their number, from a table with the group_id of each."""
    return found.agg(F.countDistinct("group_id").alias("conflicted_groups"))


def same_group(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds same_group to pairs of items first, second; false if one has no group."""
    a = membership.select(F.col("item").alias("first"), F.col("group_id").alias("_a"))
    b = membership.select(F.col("item").alias("second"), F.col("group_id").alias("_b"))
    joined = pairs.join(a, "first", "left").join(b, "second", "left")
    return joined.withColumn("same_group", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")
