"""Language identification in two steps: the family first, then pairs of languages within it.

Families are told apart by one linear support vector machine each against the rest; within a family each two languages
have one of their own, trained on those two only. All are trained here, by averaged stochastic subgradient descent on the
hinge loss. All of them are linear in the same hashed subwords, so one table of sums gives all margins of a text at once.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, texts_of
from .quality_classifier import id_fold, labelled_sample
from .subwords import BITS, WordSums, document

#: Languages by family; one that is not named here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "uralic": ["et", "fi", "hu"],
}
UNKNOWN = "und"


def family(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang.lower().split("-")[0] in own), lang)


def train_svm(docs: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, *, epochs: int = 4, decay: float = 1e-5, seed: int = 5) -> np.ndarray:
    """Weights of a linear support vector machine on unit-length documents; classes weigh the same."""
    r = np.random.default_rng(seed)
    w, total, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0
    weight = {s: len(signs) / max(2 * int((signs == s).sum()), 1) for s in (-1, 1)}
    step = 0
    for _ in range(epochs):
        for i in r.permutation(len(docs)):
            step += 1
            ids, x = docs[i]
            rate = 1 / (1 + 0.002 * step)
            w *= 1 - rate * decay if step % 64 == 0 else 1
            if signs[i] * (w[ids] @ x) < 1:
                w[ids] += rate * weight[int(signs[i])] * signs[i] * x
            if step % 16 == 0:
                total += w
                n += 1
    return total / n if n else w


def train(sample: list[tuple[str, str]]) -> dict:
    """langs, families (names), pairs, and a table of the machines' weights by bucket."""
    langs = sorted({y for _, y in sample})
    families = sorted({family(x) for x in langs})
    pairs = [(a, b) for f in families for a, b in itertools.combinations([x for x in langs if family(x) == f], 2)]
    docs = []
    for text, _ in sample:
        ids, share = document(text.lower())
        docs.append((ids, share / max(float(np.linalg.norm(share)), 1e-9)))
    y = np.array([label for _, label in sample], object)
    of = np.array([family(x) for x in y], object)
    columns = [train_svm(docs, np.where(of == f, 1, -1)) for f in families] if len(families) > 1 else []
    for a, b in pairs:
        own = np.flatnonzero((y == a) | (y == b))
        columns.append(train_svm([docs[i] for i in own], np.where(y[own] == a, 1, -1)))
    table = np.stack(columns, axis=1) if columns else np.zeros((1 << BITS, 0), np.float32)
    return {"langs": langs, "families": families, "pairs": pairs, "table": table}


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


#: Mean scores are smaller than margins of unit-length documents; this only shapes the reported score.
SCALE = 100.0


def decide(model: dict, margins: np.ndarray) -> tuple[str, float]:
    """By family, then by votes in it, the sum of margins and the name."""
    families, at, score = model["families"], 0, 1.0
    best = families[0]
    if len(families) > 1:
        own = margins[: len(families)]
        best, at = families[int(np.argmax(own))], len(families)
        score = _logistic(SCALE * float(np.max(own)))
    votes = {x: [0, 0.0] for x in model["langs"] if family(x) == best}
    least = 1.0
    for (a, b), m in zip(model["pairs"], margins[at:], strict=True):
        if a in votes:
            for lang, sign in ((a, 1), (b, -1)):
                votes[lang][0] += sign * m > 0 or (m == 0 and sign > 0)
                votes[lang][1] += sign * m
    lang = max(sorted(votes), key=lambda x: votes[x])
    for (a, b), m in zip(model["pairs"], margins[at:], strict=True):
        if lang in (a, b):
            least = min(least, _logistic(SCALE * float(m if lang == a else -m)))
    return lang, score * least


def _predicted(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model.value
    table = model["table"]
    sums = held(("languages", id(table)), lambda: (table, WordSums(table)))[1]
    for batch in batches:
        out = []
        for text in texts_of(batch):
            if not model["langs"] or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
            else:
                out.append(decide(model, sums.text(text.lower())[:-1]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def fit_languages(docs: DataFrame, *, folds: int = 4, held_out: int = 2, per_lang: int = 600):
    """The model, for all executors, from rows with a language whose crc32(doc_id as text) mod folds is not held_out.

    At most per_lang rows of each language are used, and SAMPLE_BYTES of text in all. Rows without text, id or language
    teach nothing. With one language all texts with a letter are of it; without any, every text is `und`.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = docs.where((id_fold("doc_id", folds) != held_out) & F.col("text").isNotNull()).select("doc_id", "lang", F.octet_length("text").alias("n_bytes"))
    return docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs.select("doc_id", "text"), known, "lang", per_lang)))


def languages(docs: DataFrame, model, *, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; `und` and 0 for a null text or one without letters. Reads no other column.

    Of equally good languages the one with most votes in its family wins, then the greater sum of margins, then the first
    by name. Rows are judged one by one: repeated ones alike, null ids are kept, an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(functools.partial(_predicted, model), "doc_id long, held_out boolean, lang_pred string, score double")
