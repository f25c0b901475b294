"""Quality classifier: hashed subword embeddings, averaged for each document, with a softmax over two labels.

The vectors of words and character n-grams and the output weights are learned by stochastic gradient descent in numpy
on a bounded sample of labelled rows. The output is linear in the averaged vectors, so for scoring the vectors are
projected on the output weights first and each word's projection is remembered.
"""

from __future__ import annotations

import functools
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held, texts_of
from .subwords import BITS, WordSums, document

#: Bytes of sample text that the driver takes at most.
SAMPLE_BYTES = 48_000_000
#: A bucket of a text and its share of the features.
FEATURE = np.dtype([("id", np.int32), ("share", np.float32)])


def id_fold(id_col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


def labelled_sample(docs: DataFrame, known: DataFrame, label_col: str, per_label: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, object]]:
    """Up to per_label texts of each label, those with the smallest hash of their id, in a fixed order; whole texts.

    docs: doc_id, text. known: doc_id, label_col, n_bytes of the text; a bounded number of different labels. One pass
    counts the labels and one takes somewhat more ids than are wanted, by a bound on the hash; the driver sees no more.
    Of each label's texts those are left out with which its share of most_bytes would be passed.
    """
    spark = docs.sparkSession
    known = known.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    counts = {r[0]: r.n for r in known.groupBy(label_col).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 24)
    bound = F.coalesce(*(F.when(F.col(label_col) == label, int(min(1, (1.2 * per_label + 100) / n) * 2**40)) for label, n in counts.items()))
    found = known.where(order <= bound).groupBy("doc_id", label_col).agg(F.max("n_bytes").alias("n_bytes")).withColumn("order", order)
    chosen, taken, size = [], Counter(), Counter()
    for r in sorted(found.collect(), key=lambda r: (r["order"], r["doc_id"])):
        label, n = r[label_col], r["n_bytes"]
        if taken[label] < per_label and size[label] + n <= most_bytes // len(counts):
            taken[label] += 1
            size[label] += n
            chosen.append((r["doc_id"], label))
    if not chosen:
        return []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), known.schema[label_col]])
    ids = F.broadcast(spark.createDataFrame(chosen, schema))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").where("text is not null")
    # A repeated id has one text: the longest, of equally long ones the last.
    rows = rows.groupBy("doc_id", label_col).agg(F.max(F.struct(F.octet_length("text").alias("n"), "text")).alias("most")).collect()
    return [(r["most"]["text"], r[label_col]) for r in sorted(rows, key=lambda r: (r["doc_id"], str(r[label_col])))]


def _features(sample: list[tuple[str, int]], file) -> list[np.ndarray]:
    """Each text's buckets and their shares, kept in the file: of long texts they are several times the sample's size."""
    sizes = []
    for text, _ in sample:
        ids, share = document(text, patterns=True)
        own = np.empty(len(ids), FEATURE)
        own["id"], own["share"] = ids, share
        file.write(own.tobytes())
        sizes.append(len(own))
    file.flush()
    data = np.asarray(np.memmap(file, FEATURE, "r")) if any(sizes) else np.empty(0, FEATURE)
    return np.split(data, np.cumsum(sizes)[:-1])


def train(sample: list[tuple[str, int]], *, dim: int = 8, epochs: int = 12, rate: float = 20.0, batch: int = 32, least_steps: int = 400, seed: int = 11) -> tuple[np.ndarray, float]:
    """The projected score of each bucket (for label 1 over label 0), and the bias. Classes weigh the same.

    A small sample is gone through more often than `epochs`, up to least_steps batches: with a few dozen steps the scores
    hardly leave 0, and the bias alone decides.
    """
    labels = np.array([int(y) for _, y in sample])
    if len(set(labels.tolist())) < 2:
        return np.zeros((1 << BITS, 1), np.float32), float(np.sign(labels.mean() - 0.5)) * 5 if len(labels) else 0.0
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    batches = -(-len(sample) // batch)
    epochs = max(epochs, -(-least_steps // batches))
    steps, step = epochs * batches, 0
    with tempfile.TemporaryFile() as file:
        docs = _features(sample, file)
        for _ in range(epochs):
            order = r.permutation(len(sample))
            for at in range(0, len(order), batch):
                own = [i for i in order[at : at + batch] if len(docs[i])]
                if not own:
                    continue
                lr = rate * (1 - step / steps)
                step += 1
                hidden = np.stack([np.add.reduceat(vectors[docs[i]["id"]] * docs[i]["share"][:, None], [0], axis=0)[0] for i in own])
                z = hidden @ out + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(own)), labels[own]] -= 1
                p *= weight[labels[own], None] / len(own)
                back = p @ out.T
                out -= 0.1 * lr * hidden.T @ p
                bias -= 0.01 * lr * p.sum(axis=0)
                for i, step_back in zip(own, back, strict=True):  # a document's buckets are distinct
                    vectors[docs[i]["id"]] -= lr * docs[i]["share"][:, None] * step_back
    side = out[:, 1] - out[:, 0]
    return (vectors @ side)[:, None].astype(np.float32), float(bias[1] - bias[0])


def _scorer(model) -> tuple[WordSums, float]:
    table, bias = model.value
    return held(("quality", id(table)), lambda: (table, WordSums(table)))[1], bias


def _probability(sums: WordSums, bias: float, text: str) -> float:
    return float(1 / (1 + np.exp(-np.clip(sums.text(text, patterns=True)[0] + bias, -500, 500))))


def _scored(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, bias = _scorer(model)
    for batch in batches:
        score = [_probability(sums, bias, t) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def _filtered(model, column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, bias = _scorer(model)
    for batch in batches:
        yield batch.filter(pa.array([_probability(sums, bias, t) >= 0.5 for t in texts_of(batch, column)], pa.bool_()))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", folds: int = 3, held_out: int = 1, per_label: int = 2000):
    """The model, for all executors, from labelled rows whose crc32(doc_id as text) mod folds is not held_out.

    At most per_label rows of each label are used, of those that docs has a text for, and SAMPLE_BYTES of text in all.
    Rows without label, id or text teach nothing; an id with both labels teaches both. With one label only the score is a
    constant that predicts it; without any it is 0.5, which predicts 1.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = docs.where("text is not null").select("doc_id", F.octet_length("text").alias("n_bytes"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias(label_col)).where(F.col(label_col).isin(0, 1))
    known = known.where(id_fold("doc_id", folds) != held_out)
    known = cut(known.join(sizes, "doc_id"))
    sample = labelled_sample(docs, known, label_col, per_label)
    return docs.sparkSession.sparkContext.broadcast(train(sample))


def quality_scores(docs: DataFrame, model, *, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (of label 1), predicted for each row of docs. Reads no other column.

    Null texts and texts without words have the score of the bias alone. Rows are scored one by one, so equal texts have
    equal scores, repeated rows stay, null ids are kept, and an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(functools.partial(_scored, model), "doc_id long, held_out boolean, score double, predicted int")


def keep_by_quality(docs: DataFrame, model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted as label 1, with all their columns, whatever their names.

    Null and empty texts have the score of the bias alone and are kept if it is 0.5 or more. Repeated rows fare alike; an
    empty table stays empty. A model that saw one label only keeps all rows, or none if that label is 0.
    """
    return docs.mapInArrow(functools.partial(_filtered, model, text_col), docs.schema)
