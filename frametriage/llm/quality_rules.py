"""Quality rules: a linear-chain CRF marks each line as content or boilerplate, the content share decides.

The CRF has two labels, weights for binary line features and for label pairs. It is trained here, by gradient ascent on
the likelihood, on generated pages (`training_pages`): prose in invented words with boilerplate of the usual kinds
between. The features look at marks, capitals, lengths and repetition, not at words, so that a page in another alphabet
or with other separators is judged alike. The weights are the same for every input and the operator is one pass over the rows.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1
FEATURES = ["any", "1-2 words", "3-8 words", "9-24 words", "25 words or more", "ends a sentence", "some bare marks", "many bare marks", "some words oddly marked", "many words oddly marked", "mostly capitals", "one word again and again", "few different words", "line seen before", "address or date", "mostly numbers"]
#: Marks before a blank or the end, with the blank before them if they are a word of their own.
FINAL = re.compile(r"\s?[^\w\s]+(?!\S)").findall
#: Marks that end words of sentences.
USUAL = set(".,;:!?'\")]}»«”’…。、")
ADDRESS = re.compile(r"https?://|www\.|@\w+\.\w|\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\+?\d[\d ()-]{7,}\d")


def line_features(line: str, words: list[str], seen: bool) -> list[int]:
    """Indices of the features that the line has; words: its words, at least one. No feature knows a language."""
    n = len(words)
    out = [0, 1 if n < 3 else 2 if n < 9 else 3 if n < 25 else 4]
    if words[-1][-1] in ".!?…。":
        out.append(5)
    bare = marked = 0
    for end, k in Counter(FINAL(f" {line}")).items():
        if end[0].isspace():
            bare += k
        elif not USUAL.issuperset(end) or end != "..." and len(end) > 1 and len(set(end)) == 1:
            marked += k
    if bare:
        out.append(7 if 5 * bare >= n else 6)
    if marked:
        out.append(9 if 4 * marked >= n else 8)
    if n > 2 and 2 * sum(map(str.isupper, words)) > n and sum(map(len, words)) > 3 * n:
        out.append(10)
    different = len(set(words))
    if n >= 8 and 10 * different <= n:
        out.append(11)
    elif n >= 8 and 3 * different <= n:
        out.append(12)
    if seen:
        out.append(13)
    if n < 25:
        if ADDRESS.search(line):
            out.append(14)
        if 2 * sum(w[0].isdigit() for w in words) > n:
            out.append(15)
    return out


#: Syllables of the training pages' words, and marks of their boilerplate.
SYLLABLES = ["an", "be", "den", "er", "ga", "in", "ka", "lo", "mi", "no", "on", "pre", "ra", "sta", "té", "ti", "ung", "va", "zo"]
MARKS = ["|", "•", "/", ">", "»", "-", "*", "~", "+", "#", "=", "^", "&", "→", ";", "_", "%"]


def training_pages(pages: int = 400, seed: int = 7, syllables: list[str] = SYLLABLES, marks: list[str] = MARKS) -> list[list[tuple[str, int]]]:
    """Lines with their labels: prose, with headings; and runs of menus, separated lists, decorated or repeated words, data."""
    r = random.Random(seed)
    lexicon = ["".join(r.choices(syllables, k=r.choice([1, 1, 2, 2, 3, 4]))) for _ in range(900)]

    def prose() -> str:
        out = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
            own = r.choices(lexicon, k=r.choice([1, 2, 5, 9, 14, 22]))
            own = [w + r.choice([""] * 12 + [",", ",", ";", ":"]) if r.random() < 0.99 else r.choice(["–", "&", f"({w})", f"»{w}«", str(r.randint(1, 2000))]) for w in own[:-1]] + own[-1:]
            out.append(" ".join(own).capitalize() + r.choice(["."] * 8 + ["!", "?", ".\"", "…"]))
        line = " ".join(out)
        return line.rstrip(".") if r.random() < 0.1 else line

    def some() -> list[str]:
        """Words, often with marks of sentences between and at the end."""
        own = [w + r.choice(["", "", "", "", "", ".", ","]) for w in r.choices(lexicon, k=r.choice([2, 4, 8, 20, 60, 120]))]
        return [*own[:-1], own[-1] + "."] if r.random() < 0.5 else own

    def menu() -> str:
        return " ".join(w.capitalize() for w in r.choices(lexicon, k=r.randint(1, 4)))

    def separated() -> str:
        mark = r.choice(marks)
        return f" {mark * r.choice([1, 1, 1, 2, 3])} ".join(" ".join([*r.choices(lexicon, k=r.choice([0, 0, 0, 1, 2])), w]) for w in some())

    def decorated() -> str:
        own, few = some(), r.sample(marks, min(len(marks), r.randint(1, 5)))
        return " ".join(w + r.choice(few) * r.randint(1, 3) if r.random() < 0.8 else w for w in own)

    def shouted() -> str:
        return " ".join(w.upper() + r.choice(["", "!!", "!", "??"]) for w in some())

    def repeated() -> str:
        own = r.choices(lexicon, k=r.choice([1, 1, 2, 3]))
        return " ".join(own * r.randint(8, 40)) + r.choice(["", "."])

    def data() -> str:
        number = lambda: r.choice([f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", f"+{r.randint(10, 99)} {r.randint(1000000, 9999999)}", f"https://{r.choice(lexicon)}.example/{r.choice(lexicon)}", f"{r.choice(lexicon)}@{r.choice(lexicon)}.example", str(r.randint(1, 10**6))])
        return " ".join([*r.choices(lexicon, k=r.randint(0, 2)), *(number() for _ in range(r.randint(1, 5)))])

    kinds = [menu, separated, decorated, shouted, repeated, data]
    out = []
    for _ in range(pages):
        page, label, kind, again = [], CONTENT if r.random() < 0.7 else BOILERPLATE, r.choice(kinds), menu()
        for _ in range(r.randint(1, 14)):
            if r.random() < 0.15:
                label, kind = 1 - label, r.choice(kinds)
            if label == CONTENT:
                if r.random() < 0.1:
                    page.append((menu(), label))  # a heading
                page.append((prose(), label))
            else:
                page.append((again if r.random() < 0.15 else kind(), label))
        out.append(page)
    return out


def _observed(lines: list[str]) -> list[list[int]]:
    seen: set[str] = set()
    out = []
    for line in lines:
        out.append(line_features(line, line.split(), line in seen))
        seen.add(line)
    return out


@functools.cache
def train_crf(pages: int = 400, steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of (feature, label) and (label, next label)."""
    data = training_pages(pages)
    longest = max(map(len, data))
    x = np.zeros((len(data), longest, len(FEATURES)))
    y = np.zeros((len(data), longest), int)
    there = np.zeros((len(data), longest), bool)
    for i, page in enumerate(data):
        for t, own in enumerate(_observed([line for line, _ in page])):
            x[i, t, own] = 1
        y[i, : len(page)] = [label for _, label in page]
        there[i, : len(page)] = True
    both = there[:, 1:]
    w, v = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    gold = np.eye(2)[y] * there[..., None]
    want_w = np.einsum("itf,itl->fl", x, gold)
    want_v = np.einsum("itk,itl->kl", gold[:, :-1], gold[:, 1:] * both[..., None])
    for _ in range(steps):
        unary = x @ w
        ahead = [unary[:, 0]]
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(ahead[-1][:, :, None] + v, axis=1) + unary[:, t]
            ahead.append(np.where(there[:, t, None], nxt, ahead[-1]))
        behind = [np.zeros_like(ahead[0])]
        for t in range(longest - 1, 0, -1):
            nxt = np.logaddexp.reduce(v + (unary[:, t] + behind[0])[:, None, :], axis=2)
            behind.insert(0, np.where(there[:, t, None], nxt, 0.0))
        total = np.logaddexp.reduce(ahead[-1], axis=1)
        ahead, behind = np.stack(ahead, 1), np.stack(behind, 1)
        single = np.exp(ahead + behind - total[:, None, None]) * there[..., None]
        pair = ahead[:, :-1, :, None] + v + (unary + behind)[:, 1:, None, :] - total[:, None, None, None]
        pair = np.exp(np.where(both[..., None, None], pair, -np.inf))
        n = there.sum()
        w += rate * ((want_w - np.einsum("itf,itl->fl", x, single)) / n - decay * w)
        v += rate * ((want_v - pair.sum(axis=(0, 1))) / n - decay * v)
    return w, v


def viterbi(scores: list[tuple[float, float]], v: list[list[float]]) -> list[int]:
    """The likeliest labels of a page's lines from their own scores; of equal ones, content."""
    if not scores:
        return []
    (a, b), back = scores[0], []
    for x, y in scores[1:]:
        aa, ba, ab, bb = a + v[0][0], b + v[1][0], a + v[0][1], b + v[1][1]
        back.append((int(ba > aa), int(bb > ab)))
        a, b = max(aa, ba) + x, max(ab, bb) + y
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of `size` that the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    key = at[:n]
    for k in range(1, size):
        key = np.unique(key * len(ids) + at[k : n + k], return_inverse=True)[1]
    often = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : n + k] |= often
    return int(covered.sum())


def _blanks_to_spaces(line: str) -> list[str]:
    """Words between the six ASCII blanks."""
    for c in BLANKS[1:]:
        if c in line:
            line = line.replace(c, " ")
    return [w for w in line.split(" ") if w]


def judge(text: str, model: tuple[list, list], share: float, least_words: int) -> tuple:
    w, v = model
    words = text.encode().split()
    n = len(words)
    lines, seen, duplicates, sizes, scores = text.split("\n"), set(), 0, [], []
    for line in lines:
        own = _blanks_to_spaces(line)
        if own:
            again = line in seen
            duplicates += again
            seen.add(line)
            a = b = 0.0
            for f in line_features(line, own, again):
                a += w[f][0]
                b += w[f][1]
            scores.append((a, b))
            sizes.append(len(own))
    repeats = repeated_words(words)
    failed = n < least_words or 100 * repeats > 50 * n
    kept = False
    if not failed:
        content = sum(s for s, label in zip(sizes, viterbi(scores, v), strict=True) if label == CONTENT)
        kept = content >= share * n
    chars = len(text) - sum(map(text.count, BLANKS))
    return n, chars, sum(map(text.count, SYMBOLS)), duplicates, repeats, failed, kept


COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_()}


def _judged(model, share: float, least_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column is kept as it is, the second one is the text."""
    for batch in batches:
        rows = [judge(t, model, share, least_words) for t in texts_of(batch, batch.schema.names[1])]
        columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, COLUMNS.values(), strict=True))], [batch.schema.names[0], *COLUMNS])


def _filtered(model, share: float, least_words: int, column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([judge(t, model, share, least_words)[-1] for t in texts_of(batch, column)], pa.bool_()))


def _model() -> tuple[list, list]:
    w, v = train_crf()
    return w.tolist(), v.tolist()


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5, least_words: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs.

    A text is kept if it passes the base rules and its content lines have at least `share` of its words. Null and empty
    texts have no words and fail; of equally likely labels a line's is content. Rows are judged one by one: repeated ones
    alike, null ids are kept, an empty table gives an empty one. Other columns are not read.
    """
    names = ", ".join(f"{n} {'boolean' if k == pa.bool_() else 'long'}" for n, k in COLUMNS.items())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(functools.partial(_judged, _model(), share, least_words), f"doc_id long, {names}")


def keep_by_rules(docs: DataFrame, *, text_col: str = "text", share: float = 0.5, least_words: int = 50) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever their names. Null and empty texts go."""
    return docs.mapInArrow(functools.partial(_filtered, _model(), share, least_words, text_col), docs.schema)
