"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A document is the sequence of its lines that have a word. A window is a run of it that is long enough to count: `lines`
lines, or fewer with at least `words` words. Of each window the line with the smallest hash is selected, of equal ones
the first; the selected lines are the document's fingerprints, fewer than its windows or lines, and two documents that
share a window share its fingerprint. Positions are joined by fingerprint: those that no other position shares end there.
The others are extended line by line, back and ahead, to the windows whose minimum they are, and these are compared by
128 bits of hash. The first place of a window, in the order of (doc_id, hash of the text, line), keeps it; elsewhere its
lines go. Beyond a window a match goes on with the next fingerprint's, so a repeated run of any length is deleted as the
union of its windows. A window that two shorter ones cover is left out, since it adds nothing to the union.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_back

#: A word, between the six ASCII blanks.
WORD = r"[^\\x20\\x09-\\x0D]+"
KEYS = ["d", "null_d", "h"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Documents are told apart by id and hash of the text."""
    own = F.col(id_col).cast("long")
    return docs.select(F.coalesce(own, F.lit(0)).alias("d"), own.isNull().alias("null_d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), *more)


def _around(docs: DataFrame, id_col: str, text_col: str, lines: int, second: bool) -> DataFrame:
    """KEYS, line (its number among the lines with words, from 0), around (it and lines - 1 neighbours on each side) for each such line."""
    fields = "xxhash64(x) AS h, " + "xxhash64(1, x) AS g, " * second + f"regexp_count(x, '{WORD}') AS w"
    sequence = rf"filter(transform(split(text, '\n'), x -> struct({fields})), x -> x.w > 0)"
    none = f"array_repeat(CAST(NULL AS struct<h: bigint, {'g: bigint, ' * second}w: int>), {lines - 1})"
    around = f"transform(sequence(1, size(seq) - {2 * (lines - 1)}), i -> slice(seq, i, {2 * lines - 1}))"
    seq = _keyed(docs, id_col, text_col).select(*KEYS, F.expr(f"concat({none}, {sequence}, {none})").alias("seq")).where(f"size(seq) > {2 * (lines - 1)}")
    return seq.select(*KEYS, F.posexplode(F.expr(around)).alias("line", "around"))


def _extents(lines: int) -> list[tuple[int, int]]:
    """Lines back and ahead of a position in a window."""
    return [(a, b) for a, b in itertools.product(range(lines), repeat=2) if a + b < lines]


def _selected(a: int, b: int, lines: int, words: int) -> Column:
    """Whether the lines from a back to b ahead are a window, and this line is its minimum."""
    at, low, high = lines - 1, lines - 1 - a, lines - 1 + b
    line = lambda k: F.col("around")[k]
    total = lambda lo, hi: sum((line(k)["w"] for k in range(lo + 1, hi + 1)), line(lo)["w"])
    own = line(low).isNotNull() & line(high).isNotNull()
    if a + b + 1 < lines:
        own &= total(low, high) >= words
    if a + b > 0:
        own &= ~((total(low, high - 1) >= words) & (total(low + 1, high) >= words))
    for k in range(low, high + 1):
        if k != at:
            own &= line(k)["h"] > line(at)["h"] if k < at else line(k)["h"] >= line(at)["h"]
    return own


def line_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines: int = 3, words: int = 50, windows: bool = True) -> DataFrame:
    """d, null_d, h, line, fp (hash of the line) for each selected line; with windows, those whose minimum it is: x, y (hashes), first, last (line numbers)."""
    rows = _around(docs, id_col, text_col, lines, windows)
    at, found = lines - 1, {e: _selected(*e, lines, words) for e in _extents(lines)}
    columns = [*KEYS, "line", F.col("around")[at]["h"].alias("fp")]
    anywhere = F.coalesce(*(F.when(ok, True) for ok in found.values()), F.lit(False))
    if not windows:
        return rows.where(anywhere).select(*columns)
    own = []
    for (a, b), ok in found.items():
        part = [F.col("around")[k] for k in range(at - a, at + b + 1)]
        x, y = F.xxhash64(*(p["h"] for p in part)), F.xxhash64(*(p["g"] for p in part))
        own.append(F.when(ok, F.struct(x.alias("x"), y.alias("y"), (F.col("line") - a).alias("first"), (F.col("line") + b).alias("last"))))
    return rows.where(anywhere).select(*columns, F.array_compact(F.array(*own)).alias("windows"))


def repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """d, null_d, h, removed (numbers, among the lines with words, of those to delete) for each document that has any."""
    # Pre-aggregated before the shuffle; in the joins a frequent key's rows are split by the skew join.
    shared = line_fingerprints(docs, windows=False, **options).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    found = join_back(line_fingerprints(docs, **options), shared, ["fp"])
    windows = found.select(*KEYS, F.inline("windows"))
    place = F.struct("null_d", "d", "h", "first")
    firsts = windows.groupBy("x", "y").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    matches = join_back(windows, firsts, ["x", "y"]).where(place > F.col("least"))
    return matches.select(*KEYS, F.explode(F.sequence("first", "last")).alias("line")).groupBy(*KEYS).agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lines: int = 3, words: int = 50, counts: bool = True) -> DataFrame:
    """All rows and columns of docs, the text without later repeats of line runs; with counts, also n_lines and n_removed.

    A line is deleted if it is in a run of lines with words, of `lines` lines or of fewer with `words` words, that has an
    equal run at an earlier place, in the same document or another. Lines without words are passed over and stay. Null
    texts stay null (0 lines), an empty one has 1 line. Rows alike in id and text are one document and fare alike; rows
    with a null id come last in the order. With counts, columns of docs called n_lines or n_removed, in upper or lower
    case, are replaced. Other columns are kept whatever their names.
    """
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, lines=lines, words=words)
    names = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_removed")]
    rows = _keyed(docs, id_col, text_col, F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != text_col), F.lit(0).alias("_")).alias("row"))
    joined = rows.join(gone, KEYS, "left")
    # Bound to a lambda's variable, the arrays are made once for a text, not once for a line.
    raw = rf"filter(transform(split(text, '\n'), (x, i) -> IF(x RLIKE '{WORD}', i, -1)), i -> i >= 0)"
    kept = "array_except(sequence(0, size(s.own) - 1), transform(s.removed, k -> s.raw[k]))"
    left = F.expr(rf"transform(array(struct(split(text, '\n') AS own, {raw} AS raw, removed)), s -> array_join(transform({kept}, i -> s.own[i]), '\n'))[0]")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    columns = [text.alias(c) if c == text_col else F.col("row").getField(f"c{k}").alias(c) for k, c in enumerate(names)]
    if counts:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
        columns += [n_lines.alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed")]
    return joined.select(*columns)


def dedup_sql(lines: int = 3, words: int = 50) -> str:
    """DuckDB: doc_id, n_lines, n_removed, n_chars, text_md5 of the documents after dedup_lines; equal spans by their text."""
    blank = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), s AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^' || {blank} || ']+')) AS w FROM l
), q AS (
  SELECT doc_id, pos, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM s WHERE w > 0
), spans AS (
  SELECT a.doc_id, a.i, k.k, list(b.line ORDER BY b.i) AS text, list(b.pos ORDER BY b.i) AS ats, sum(b.w) AS w
  FROM q a, range(1, {lines + 1}) k(k), q b
  WHERE b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + k.k - 1
  GROUP BY a.doc_id, a.i, a.pos, k.k HAVING count(*) = k.k AND (k.k = {lines} OR sum(b.w) >= {words})
), firsts AS (
  SELECT text, min((doc_id, ats[1])) AS place FROM spans GROUP BY text
), gone AS (
  SELECT DISTINCT doc_id, unnest(ats) AS pos FROM spans JOIN firsts USING (text) WHERE (doc_id, ats[1]) > place
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM kept"""
