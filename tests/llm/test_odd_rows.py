"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing names, for every operator and stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from frametriage.llm.common import tokenizer_file
from frametriage.llm.language_id import decide, fit_languages, languages
from frametriage.llm.licenses import license_scan
from frametriage.llm.line_dedup import dedup_lines
from frametriage.llm.media import document_media
from frametriage.llm.packing import pack
from frametriage.llm.piece_codec import piece_digests
from frametriage.llm.quality_classifier import fit_quality, keep_by_quality, quality_scores
from frametriage.llm.quality_rules import quality_rules
from frametriage.llm.simhash import simhash_groups
from frametriage.llm.token_counts import token_counts

TEXTS = [None, "", " \n\t", "word", "Fine words here. " * 40, "Fine words here. " * 40, "a" * 300_000, "x y z\n" * 60_000, "é\u3000ü " * 20_000, "<|endoftext|>▁▁ \x00"]
#: Columns that the operators make or use inside have other contents and types here.
CLASH = ["row", "fp", "key", "keys", "_keys", "head", "n", "h", "d", "line", "window", "digest", "kept", "score", "held_out", "piece", "length", "PRETOKEN", "n_bytes", "component_id", "Removed", "order", "label"]


def table(spark, rows=None):
    rows = [(i if i != 1 else None, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (4, "other")] if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.lit("?").alias(c) for c in CLASH))


OPERATORS = {
    "op1": lambda df: token_counts(df, tokenizer_file("word_bpe_49k.json")),
    "op2": lambda df: piece_digests(df, tokenizer_file("piece_bpe_32k.model")),
    "op3": dedup_lines,
    "op4": license_scan,
    "op5": quality_rules,
    "op6": lambda df: quality_scores(df, fit_quality(df, df.sparkSession.createDataFrame([(3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int"))),
    "op7": document_media,
    "op8": lambda df: pack(df, tokenizer_file("byte_bpe_50k.json")).where("piece = 0"),
    "op9": lambda df: languages(df, fit_languages(df)),
    "op10": simhash_groups,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    docs = table(spark)
    rows = OPERATORS[name](docs).collect()
    assert Counter(x.doc_id for x in rows) == Counter(x.doc_id for x in docs.select("doc_id").collect())
    # Rows alike in id and text fare alike; where the id plays no part, so do equal texts.
    alike = [tuple(x) for x in rows if x.doc_id == 4]
    if name == "op8":
        assert sum(x.length for x in rows if x.doc_id == 4) > 0
    else:
        assert len(alike) == 3 and len(set(alike)) <= 2
    if name in ("op4", "op5"):
        assert [tuple(x)[1:] for x in rows if x.doc_id == 5][0] in {x[1:] for x in alike}
    assert OPERATORS[name](table(spark, [])).collect() == []
    if name == "op1":
        assert [(x.n_bytes, x.n_tokens) for x in rows if x.doc_id in (0, None)] == [(0, 0)] * 2
    if name == "op3":
        assert {x.doc_id: x.text for x in rows}[0] is None
    if name == "op9":
        assert {x.doc_id: (x.lang_pred, x.score) for x in rows if x.doc_id in (0, None, 2)} == {i: ("und", 0.0) for i in (0, None, 2)}


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, k, tmp_path):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    for docs in (table(spark), table(spark, [])):
        path = f"{tmp_path}/{docs.count()}"
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(3, 0), (4, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        out = stage(spark, docs, path)
        rows = out.collect()
        if name == "packing":
            assert {x.doc_id for x in rows} == {x.doc_id for x in docs.select("doc_id").collect()}
            continue
        assert out.columns == docs.columns and len(rows) <= docs.count()
        if name == "quality_rules":
            assert all(x.text for x in rows)
        if name == "line_dedup":
            assert len(rows) == docs.count() and all(x.n_chars == (None if x.text is None else len(x.text)) for x in rows)
        if name == "near_duplicates":
            assert len(rows) < len(TEXTS) or not rows


def test_ties():
    model = {"langs": ["a", "b", "c"], "families": ["f"], "pairs": [("a", "b"), ("a", "c"), ("b", "c")], "table": None}
    import frametriage.llm.language_id as module

    before, module.family = module.family, lambda lang: "f"
    try:
        assert decide(model, [0.0, 0.0, 0.0])[0] == "a"  # equal margins count for the first of the pair
        assert decide(model, [1.0, -1.0, 1.0])[0] == "a"  # a vote each and equal sums: the first by name
        assert decide(model, [1.0, -2.0, 1.0])[0] == "c"  # a vote each: the greater sum
    finally:
        module.family = before


def test_one_label_only(spark):
    docs = table(spark)
    for label, kept in ((1, docs.count()), (0, 0)):
        model = fit_quality(docs, spark.createDataFrame([(4, label), (7, label)], "doc_id long, quality int"))
        assert keep_by_quality(docs, model).count() == kept
    assert keep_by_quality(docs, fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == docs.count()
