"""SentencePiece BPE encoding by backtracking, and decoding.

The merge-based encoding of a text is the only sequence of pieces in which every two neighbours are compatible: merging
their joined text anew gives back the same two pieces. So the search takes the longest piece that matches at a position
(all matches come from one Aho-Corasick pass), checks it against the piece before it, goes on to shorter ones, and steps
back where none fits. Each position is reached by one sequence only, so a position that has failed once is marked
and never tried again, and the time stays linear.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, MEMO_BYTES, held, texts_of

#: The library's stand-in for a blank.
BLANK = "▁"


class PieceCodec:
    """Encodes as the model file says: blank before the text, no other normalization, bytes for unknown characters."""

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.names = {i: sp.id_to_piece(i) for i in plain}
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.matcher = ahocorasick.Automaton()
        for i in plain:
            self.matcher.add_word(self.names[i], i)
        self.matcher.make_automaton()
        self.length = {i: len(p) for i, p in self.names.items()}
        #: So every position within a piece has a match, no piece reaches over one without, and some sequence always fits.
        assert all(c in self.score for p in self.score for c in p), "characters that are no pieces"
        #: No merge goes over a blank that follows another character, or over a character of no piece.
        assert not any(BLANK in p.lstrip(BLANK) for p in self.names.values()), "pieces with inner blanks"
        self.lines = not any("\n" in p for p in self.names.values())
        self.chunks = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo, self.used = memo, 0
        self.after_blank: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.newline = self.packed(self.unknown("\n"))

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def unknown(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unk) for b in char.encode()] if self.bytes else [self.unk]

    def merged(self, text: str) -> list[str]:
        """Merges the best pair first, of equal ones the left one."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """left -1: whether the piece is what its own text merges to."""
        known = self.fits.get((left, right))
        if known is None:
            parts = [self.names[right]] if left < 0 else [self.names[left], self.names[right]]
            known = self.merged("".join(parts)) == parts
            if 200 * len(self.fits) >= self.memo:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def chunk(self, text: str) -> list[int]:
        matches: list[list[int]] = [[] for _ in text]
        length = self.length
        for end, i in self.matcher.iter(text):
            matches[end + 1 - length[i]].append(i)  # at each start the shorter ones come first
        out, begin, n = [], 0, len(text)
        while begin < n:
            if not matches[begin]:
                out += self.unknown(text[begin])
                begin += 1
                continue
            stop = begin + 1
            while stop < n and matches[stop]:
                stop += 1
            out += self.search(matches, begin, stop)
            begin = stop
        return out

    def search(self, matches: list[list[int]], begin: int, stop: int) -> list[int]:
        failed = bytearray((stop - begin) // 8 + 1)
        fits, compatible, length = self.fits, self.compatible, self.length
        pieces: list[int] = []
        tried: list[int] = []
        at, k = begin, len(matches[begin]) - 1
        while at < stop:
            own, last = matches[at], pieces[-1] if pieces else -1
            while k >= 0:
                piece = own[k]
                to = at + length[piece] - begin
                if not failed[to >> 3] >> (to & 7) & 1:
                    fit = fits.get((last, piece))
                    if compatible(last, piece) if fit is None else fit:
                        break
                k -= 1
            if k >= 0:
                pieces.append(piece)
                tried.append(k)
                at = begin + to
                k = len(matches[at]) - 1 if at < stop else 0
            else:
                failed[at - begin >> 3] |= 1 << (at - begin & 7)
                at -= length[pieces.pop()]
                k = tried.pop() - 1
        return pieces

    def encode(self, text: str) -> bytes:
        """The ids with begin and end, as little-endian unsigned 32-bit integers."""
        out = [self.packed([self.bos])]
        if text:
            text = BLANK + text.replace(" ", BLANK)
            after, start = self.after_blank, self.at_start
            for k, line in enumerate(text.split("\n") if self.lines else [text]):
                if k:
                    out.append(self.newline)
                if BLANK + BLANK in line:
                    out += [self.remember(start, c, "") if (ids := start.get(c)) is None else ids for c in self.chunks(line)]
                    continue
                first, *rest = line.split(BLANK)
                if first:
                    ids = start.get(first)
                    out.append(self.remember(start, first, "") if ids is None else ids)
                for part in rest:
                    ids = after.get(part)
                    out.append(self.remember(after, part, BLANK) if ids is None else ids)
        out.append(self.packed([self.eos]))
        return b"".join(out)

    def remember(self, table: dict[str, bytes], part: str, before: str) -> bytes:
        ids = self.packed(self.chunk(before + part))
        if len(part) < LONG_WORD:
            self.used += 250 + len(part) + len(ids)
            if self.used > self.memo:
                self.after_blank.clear()
                self.at_start.clear()
                self.used = 0
            table[part] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def codec(path: str) -> PieceCodec:
    return held(("pieces", path), lambda: PieceCodec(path))


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        n, a, b = [], [], []
        for text in texts_of(batch):
            ids = own.encode(text)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        ids = [np.frombuffer(own.encode(t), "<u4").astype(np.int32) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path).library
    for batch in batches:
        texts = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def piece_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with begin and end) for each row; null texts are encoded as empty ones. Other columns are not read."""
    return _input(docs, id_col, text_col).mapInArrow(functools.partial(_encoded, path), "doc_id long, ids array<int>")


def piece_texts(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give null."""
    return encoded.select("doc_id", "ids").mapInArrow(functools.partial(_decoded, path), "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; nulls as in piece_ids."""
    return _input(docs, id_col, text_col).mapInArrow(functools.partial(_digests, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
