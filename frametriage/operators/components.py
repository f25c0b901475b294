"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import join_back


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir. Where none is set, local mode takes a temporary folder and a cluster is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, in any order."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, root for every node that has an edge; root is the smallest node of its component.

    Self-loops name no node. Minima are pre-aggregated before each shuffle and joined back to the edges, so
    that a hub's edges are split by the skew join. The rounds end when the edge set no longer changes.
    """
    use_checkpoint_dir(edges.sparkSession)
    a, b = F.col(left), F.col(right)
    now = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct().checkpoint()
    seen = _digest(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_back(both, least, ["u"]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = join_back(large, least, ["a"])
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = joined.select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a != b").distinct().checkpoint()
        if (new := _digest(now)) == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
