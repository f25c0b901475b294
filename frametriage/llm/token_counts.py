"""Token counts without token ids.

The pieces of a pre-token do not depend on its document, so each distinct pre-token is segmented once. A document's
count is the sum over its pre-tokens of frequency times pieces: a join of two tables and a sum. Frequent pre-tokens
(at most `hot` of the most frequent ones, a bounded table) are added up where the text is read; the others are joined by shuffle.
So no key of the shuffled join is frequent, and most of the frequencies never leave their task.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_alphabet, cut, held, row_numbers, single_threaded

#: Entries of a counter that are kept before they are handed on.
ENTRIES = 400_000
#: Bytes of text that are taken apart at a time, or one text.
PART_BYTES = 8_000_000
#: What the tokenizer file says on normalization and splitting.
FILE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
}
#: Marks a special token's string among the pre-tokens.
SPECIAL = "\x00"


class PreTokenizer:
    """Splits a text as the tokenizer file says, into pre-tokens in its byte alphabet."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        assert FILE == {"normalizer": file["normalizer"], "split": file["pre_tokenizer"]["pretokenizers"][0]["pattern"]}, "another way of splitting"
        assert all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in file["added_tokens"]), "another kind of special token"
        self.model = self.tokenizer.model
        names = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        #: The split pattern on lower-case printable ASCII, where letters are a-z and bytes stand for themselves.
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
        #: Printable Latin characters that normalization only changes to lower case, each by itself.
        self.latin = re.compile(r"[!-~¡-¬®-įı-ɏ]+").fullmatch
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|[\W_]+").findall
        self.letters = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})

    def unit(self, unit: str) -> list[str]:
        """Pre-tokens of a text between blanks."""
        if self.special and "<|" in unit and self.special.search(unit):
            out, at = [], 0
            for m in self.special.finditer(unit):
                out += [*self.plain(unit[at : m.start()]), SPECIAL + m[0]]
                at = m.end()
            return out + self.plain(unit[at:])
        return self.plain(unit)

    def plain(self, unit: str) -> list[str]:
        if unit.isascii() and unit.isprintable() and " " not in unit:
            unit = unit.lower()
            return [unit] if unit.isalpha() else self.ascii(unit)
        if self.latin(unit):
            return [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in self.split(unit.lower())]
        unit = self.tokenizer.normalizer.normalize_str(unit)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(unit)]

    def pieces(self, pretoken: str) -> int:
        return 1 if pretoken.startswith(SPECIAL) else len(self.model.tokenize(pretoken))


def pretokenizer(path: str) -> PreTokenizer:
    return held(("pre-tokens", path), lambda: PreTokenizer(path))


def units(text: str) -> list[str]:
    """Pre-tokens never hold a blank or a line end, and normalization does not reach over them."""
    return text.replace("\n", " ").split(" ")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[str]]]:
    """Rows of the batch with some MB of text, where each row's units begin, all units as numbers, and the distinct units."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()) // PART_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for at, end in zip(starts, [*starts[1:], len(batch)], strict=False):
        rows = batch.slice(at, end - at)
        own = pc.split_pattern(pc.replace_substring(pc.fill_null(rows.column("text"), ""), "\n", " "), " ")
        found = own.flatten().dictionary_encode()
        yield rows, np.cumsum([0, *pc.list_value_length(own).to_numpy()[:-1]]), found.indices.to_numpy(), found.dictionary.to_pylist()


def _vocabulary(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, counts = pretokenizer(path).unit, Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"pretoken": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in batches:
        for _, _, at, distinct in _parts(batch):
            for unit, n in zip(distinct, np.bincount(at).tolist(), strict=True):
                for p in split(unit):
                    counts[p] += n
            if len(counts) > ENTRIES:
                yield rows()
                counts.clear()
    yield rows()


def _pieces(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = pretokenizer(path).pieces
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(pieces, batch.column(0).to_pylist())), pa.int32())], ["pretoken", "n", "pieces"])


def _frequencies(path: str, hot, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with the pieces of its hot pre-tokens, one for each other pre-token in it."""
    split, hot, ids = pretokenizer(path).unit, hot.value, row_numbers()
    for batch in batches:
        for rows, starts, at, distinct in _parts(batch):
            base, others, begins, cold = np.zeros(len(distinct), np.int64), [], [0], {}
            for k, unit in enumerate(distinct):
                for p in split(unit):
                    if (n := hot.get(p)) is not None:
                        base[k] += n
                    else:
                        others.append(cold.setdefault(p, len(cold)))
                begins.append(len(others))
            # Each unit's other pre-tokens, for each time that it occurs; then counted for each document.
            begins, others = np.array(begins), np.array(others, np.int64)
            sizes = np.diff(begins)
            doc = np.repeat(np.arange(len(rows)), np.diff(starts, append=len(at)))
            some = np.flatnonzero(sizes[at])
            times = sizes[at[some]]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            other = others[np.repeat(begins[at[some]], times) + inner]
            key, n = np.unique(np.repeat(doc[some], times) * max(len(cold), 1) + other, return_counts=True)
            own = np.fromiter(ids, np.int64, len(rows))
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, own[key // max(len(cold), 1)]])),
                    pa.concat_arrays([pa.array([f"\x01{k}" for k in own.tolist()], pa.string()), pa.array(list(cold), pa.string()).take(pa.array(key % max(len(cold), 1)))]),
                    pa.concat_arrays([rows.column("doc_id"), none]),
                    pa.concat_arrays([pc.fill_null(pc.binary_length(rows.column("text")), 0).cast(pa.int64()), none]),
                    pa.array(np.concatenate([np.add.reduceat(base[at], starts), np.zeros(len(key), np.int64)])),
                    pa.array(np.concatenate([np.zeros(len(rows), np.int64), n])),
                ],
                ["row", "pretoken", "doc_id", "n_bytes", "base", "n"],
            )


def pretoken_pieces(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """pretoken, n (its occurrences in all texts), pieces: one row for each distinct pre-token."""
    texts = docs.select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(functools.partial(_vocabulary, path), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(functools.partial(_pieces, path), "pretoken string, n long, pieces int")


def _least_frequency(pieces: DataFrame, most: int) -> int:
    """A frequency that at most so many pre-tokens have or pass. From a histogram, so that no task gathers the candidates of all others."""
    eighth = F.floor(F.log2("n") * 8)
    counts = pieces.groupBy(eighth.alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(counts, key=lambda r: -r["b"]):
        total += r["k"]
        if total > most:
            break
        least = r["least"]
    return least


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, hot: int = 131_072) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    Null texts count as empty: 0 bytes, 0 tokens. Rows are kept apart even if they repeat; ids may be null. Other
    columns of docs are not read. `hot` bounds the table that is sent to all executors; it changes no result. Rows are
    numbered in their tasks, so docs must give them in the same order again if a task is lost, as files do; cut() anything else.
    """
    spark = docs.sparkSession
    pieces = cut(pretoken_pieces(docs, path, text_col=text_col))
    top = pieces.where(F.col("n") >= _least_frequency(pieces, hot)).select("pretoken", "pieces").toArrow()
    table = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(functools.partial(_frequencies, path, table), "row long, pretoken string, doc_id long, n_bytes long, base long, n long")
    # A document's own row has a key that no pre-token has, so that one shuffle serves both kinds of rows.
    joined = rows.join(pieces.select("pretoken", "pieces").hint("merge"), "pretoken", "left")
    n_tokens = F.sum(F.col("base") + F.col("n") * F.coalesce("pieces", F.lit(0)))
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), n_tokens.alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
