import random
from collections import defaultdict

import duckdb
import pytest

from frametriage.llm.line_dedup import dedup_lines, dedup_sql, line_fingerprints


def words(line):
    return line.encode().split()


def brute_force(rows, lines=3, least=50):
    """rows: (doc_id, text) without repeats; every span that counts, at every place."""
    places = defaultdict(list)
    for doc, text in rows:
        own = [(i, x) for i, x in enumerate((text or "").split("\n")) if words(x)] if text is not None else []
        for i in range(len(own)):
            for k in range(1, len(own) - i + 1):
                span = own[i : i + k]
                if k >= lines or sum(len(words(x)) for _, x in span) >= least:
                    places[tuple(x for _, x in span)].append((doc, span[0][0], [j for j, _ in span]))
    gone = defaultdict(set)
    for found in places.values():
        first = min(found)[:2]
        for doc, at, own in found:
            if (doc, at) != first:
                gone[doc] |= set(own)
    return {doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc]) for doc, text in rows}


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    pool = ["a b", "c", "", " \t", "d e f", "g " * 20 + "h", "i " * 55, "j " * 30, "k"]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 9)))) for i in range(40)] + [(90, None), (91, ""), (92, "\n\n")]
    got = {x.doc_id: x.text for x in dedup_lines(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, removed int")).collect()}
    assert got == brute_force(rows)


def plain_windows(text, lines=3, least=50):
    """Numbers of the first and last line of each window that no two shorter ones cover."""
    n = [len(words(x)) for x in text.split("\n") if words(x)]
    counts = lambda i, k: k == lines or k > 0 and sum(n[i : i + k]) >= least
    long = lambda i, k: k > 0 and sum(n[i : i + k]) >= least
    return {(i, i + k - 1) for i in range(len(n)) for k in range(1, min(lines, len(n) - i) + 1) if counts(i, k) and not (k > 1 and long(i, k - 1) and long(i + 1, k - 1))}


def test_winnowing(spark):
    r = random.Random(3)
    line = lambda: " ".join(r.choices("abcdefgh", k=r.choice([1, 3, 9, 30, 60])))
    shared = [line() for _ in range(4)]
    texts = ["\n".join([*(line() for _ in range(r.randint(0, 9))), *shared, *(line() for _ in range(r.randint(0, 9)))]) for _ in range(12)] + ["", "\n \n", "x"]
    rows = line_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = defaultdict(list)
    for x in rows:
        found[x.d].append(x)
    for i, text in enumerate(texts):
        own = [(w["first"], w["last"]) for x in found[i] for w in x.windows]
        assert len(own) == len(set(own)) and set(own) == plain_windows(text)  # each window has one fingerprint
        assert all(w["first"] <= x.line <= w["last"] for x in found[i] for w in x.windows)
    assert len(rows) < 0.8 * sum(len(x.windows) for x in rows) and len(rows) < sum(len(words(t.replace("\n", " "))) > 0 and len([x for x in t.split("\n") if words(x)]) for t in texts)
    # Every guaranteed repeat shares one: the texts share a run of four lines.
    assert set.intersection(*({x.fp for x in found[i]} for i in range(12)))
    some = {(x.d, x.line) for x in line_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), windows=False).collect()}
    assert some == {(x.d, x.line) for x in rows}


def test_names_and_very_long_texts(spark):
    long = "\n".join(f"line {i % 400} of it" for i in range(30_000))
    docs = spark.createDataFrame([(1, long, 1, 2, "a"), (2, long + "\nend", 1, 2, "b"), (3, "w " * 400_000, 1, 2, "c"), (4, "w " * 400_000, 1, 2, "d")], "doc_id long, text string, N_Lines int, N_removed int, row string")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "row", "n_lines", "n_removed"]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.row) for x in out.collect()}
    assert got == {1: (30_000, 29_600, "a"), 2: (30_001, 30_000, "b"), 3: (1, 0, "c"), 4: (1, 1, "d")}
    assert dedup_lines(docs, counts=False).columns == docs.columns


def test_columns_nulls_and_repeats(spark):
    passage = "w " * 60 + "."
    rows = [(None, passage, 1, "x"), (2, passage, 2, "y"), (2, passage, 2, "y"), (3, f"own\n{passage}\nend", 3, "z")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines int, h string"))
    assert got.columns == ["doc_id", "text", "h", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, "", "x", 1, 1), (2, passage, "y", 1, 0), (2, passage, "y", 1, 0), (3, "own\nend", "z", 3, 1)], key=str)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql(spark):
    r = random.Random(9)
    pool = ["a b", "c", "", "d e f", "i " * 55, "j " * 30, "k"]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(1, 8)))) for i in range(60)]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    import hashlib

    want = brute_force(rows)
    got = {x[0]: x[4] for x in con.sql(dedup_sql()).fetchall()}
    assert got == {k: hashlib.md5(v.encode()).hexdigest() for k, v in want.items()}


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
