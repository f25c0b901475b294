import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from frametriage.llm.common import tokenizer_file
from frametriage.llm.packing import best_two_fit, byte_tokens, cuts, pack

PATH = tokenizer_file("byte_bpe_50k.json")
MIX = st.text(st.one_of(st.sampled_from("abeinst 'THE.<|>\n\t  é日½12"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=600, deadline=None)
@given(MIX)
def test_ids_match_library(text):
    t = byte_tokens(PATH)
    assert np.frombuffer(t.ids(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def one_by_one(lengths, size):
    """Best-two-fit without repeating patterns."""
    left, bins = Counter(lengths), []
    while left:
        own, gap = [], size
        while fits := [x for x in left if x <= gap]:
            own.append(max(fits))
            gap -= own[-1]
            left -= Counter(own[-1:])
        if gap and len(own) > 1:
            room = gap + own[-1]
            pairs = [(x + y, x) for x in left for y in left if y <= x and x + y <= room and (x != y or left[x] > 1)]
            if pairs and max(s for s, _ in pairs) > own[-1]:
                s = max(p[0] for p in pairs)
                x = min(p[1] for p in pairs if p[0] == s)
                left -= Counter([x, s - x])
                left += Counter([own.pop()])
                own += [x, s - x]
        bins.append(sorted(own, reverse=True))
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_best_two_fit(lengths):
    plan = best_two_fit(Counter(lengths), 30)
    assert sorted(p for p, n in plan for _ in range(n)) == one_by_one(lengths, 30)


def test_cuts():
    assert cuts(1, 4) == [(0, 1)] and cuts(4, 4) == [(0, 4)] and cuts(5, 4) == [(0, 1), (1, 4)] and cuts(8, 4) == [(0, 4), (4, 4)]


def test_pack(spark):
    r = random.Random(1)
    texts = [None, "", "<|endoftext|>x", "a  b\t\nc"] + ["word " * r.choice([3, 3, 3, 40, 100, 333, 700]) + str(r.random()) for _ in range(300)] + ["x y " * 3000]
    rows = [(i // 2 if i != 9 else None, t, 1) for i, t in enumerate(texts)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, row long"), PATH, shard_rows=20).collect()
    lib = byte_tokens(PATH).tokenizer
    want = Counter()
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        for k, (start, n) in enumerate(cuts(len(ids), 1024)):
            want[i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter(tuple(x)[:5] for x in got) == want
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 1024
    assert len(bins) == len(one_by_one([x.length for x in got], 1024))
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
