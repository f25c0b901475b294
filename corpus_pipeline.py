"""A training corpus from `documents`: rules, classifier, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametriage.llm.common import checkpoint_dir, documents, tokenizer_file
from frametriage.llm.line_dedup import dedup_lines
from frametriage.llm.packing import pack
from frametriage.llm.quality_classifier import fit_quality, keep_by_quality
from frametriage.llm.quality_rules import keep_by_rules
from frametriage.llm.simhash import keep_representatives


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the rules reject go."""
    return keep_by_rules(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that it rejects go. Trained on the whole table, since the rules leave hardly any low-quality one here."""
    return keep_by_quality(docs, fit_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later repeats of line runs go from the texts; n_chars follows. No row goes."""
    kept = dedup_lines(docs, counts=False)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(chars.alias(c) if c == "n_chars" else f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group the document with the smallest id stays; where ids repeat, keep_representatives says which."""
    return keep_representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]
#: Trained models, fingerprints and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the folder that executors share and read by the next, which then deletes it."""
    checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
