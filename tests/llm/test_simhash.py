import random

import numpy as np
import pytest
import xxhash

from frametriage.llm.simhash import fingerprint, fingerprint_keys, fingerprint_links, keep_representatives, refined_keys, simhash_groups
from frametriage.operators.components import connected_components


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, near):
    left, out = set(items), {}
    while left:
        ahead = [left.pop()]
        own = set(ahead)
        while ahead:
            x = ahead.pop()
            found = {y for y in left if near(x, y)}
            left -= found
            own |= found
            ahead += found
        out |= dict.fromkeys(own, frozenset(own))
    return out


def differ(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def test_fingerprints():
    for t in ["", " \t\n", "one", "One two", "A b c d e", "ÀB c\x0bd e f g " * 9, "word " * 70_000]:
        assert fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)


def test_keys_are_shared_within_three_bits():
    r = random.Random(1)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        keys, rows = fingerprint_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_second_level_keys_are_shared_within_three_bits():
    r = random.Random(6)
    for _ in range(1000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 3)):
            b ^= 1 << bit
        fp = np.array([a, b], np.uint64).view(np.int64)
        keys, rows = fingerprint_keys(fp)
        for key in set(keys[rows == 0]) & set(keys[rows == 1]):
            second, of = refined_keys(np.array([key, key]), fp)
            assert set(second[of == 0]) & set(second[of == 1])
            assert set(second >> 13) == {key}


@pytest.mark.parametrize("bucket", [2048, 12, 3, 1])
def test_links_join_up_all_groups(spark, bucket):
    r = random.Random(2)
    fps = {0, -1}
    for _ in range(6):
        c = r.getrandbits(64)
        for _ in range(30):
            x = c
            for bit in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << bit
            fps.add(x - (1 << 64) if x >> 63 else x)
    links = fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket=bucket).collect()
    assert all(differ(x.a, x.b) <= 3 for x in links)
    linked = {(x.a, x.b) for x in links}
    want = groups(fps, lambda a, b: differ(a, b) <= 3)
    assert groups(fps, lambda a, b: (a, b) in linked or (b, a) in linked) == want


def test_groups_match_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "a", "A", "a b", "x y z", "X y z"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(200)]
        for _ in range(4):
            own = list(base)
            if r.random() < 0.7:
                own[r.randrange(200)] = r.choice(words)
            texts.append(" ".join(own))
    rows = [(i + 5 if i != 3 else None, t, i) for i, t in enumerate(texts)]
    got = {(x.doc_id, x.fingerprint, x.component_id) for x in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp long")).collect()}
    fp = {i: plain_fingerprint(t or "") for i, t, _ in rows}
    own = groups(set(fp.values()), lambda a, b: differ(a, b) <= 3)
    want = {(i, f"{fp[i]:016x}", min(j for j in fp if j is not None and fp[j] in own[fp[i]])) for i in fp}
    assert got == want
    assert len({x[2] for x in got}) < len(rows) - 20


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert simhash_groups(spark.createDataFrame([], schema)).count() == 0
    assert sorted(tuple(x) for x in simhash_groups(spark.createDataFrame([(1, "a"), (1, "a")], schema)).collect()) == [(1, f"{plain_fingerprint('a'):016x}", 1)] * 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives_where_names_clash_and_ids_repeat(spark):
    rows = [(1, "a b c", 1, 2, 3), (1, "a b c", 0, 2, 3), (2, "a b c", 1, 2, 3), (4, "x y z", 9, 2, 3), (4, "X y z", 9, 2, 3), (None, None, 1, 2, 3), (None, "", 0, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, Head int, _fp int")
    got = keep_representatives(docs)
    assert got.schema == docs.schema
    first = sorted(map(tuple, got.collect()), key=str)
    assert [x[:2] for x in first] == [(1, "a b c"), (4, "X y z"), (None, None)]
    assert first == sorted(map(tuple, keep_representatives(docs.orderBy("_id", "text").repartition(3)).collect()), key=str)
    unique = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in enumerate(["a b c", "a b c", None, "", "q"])], docs.schema)
    assert sorted(x.doc_id for x in keep_representatives(unique).collect()) == [0, 2, 4]
    assert keep_representatives(docs.limit(0)).collect() == []
