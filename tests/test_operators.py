"""Operators of grouping, scores, reports and export beyond what the queries show."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from frametriage import errors, settings
from frametriage.functions import phash, photo, score
from frametriage.operators import export, report, similarity
from frametriage.settings import Settings


def items(spark, hashes):
    return spark.createDataFrame(list(enumerate(hashes)), "item long, hash long")


def group_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_id, set()).add(r.item)
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize(
    ("hashes", "t", "want"),
    [
        ([0, 3], 2, [{0, 1}]),
        ([0, 3], 1, [{0}, {1}]),
        ([0, 3, 0xFF], 6, [{0, 1, 2}]),
        ([0, -1], 63, [{0}, {1}]),
        ([0, -1], 64, [{0, 1}]),
        ([7] * 50, 0, [set(range(50))]),
        ([0, 3, 0xF0], 2, [{0, 1}, {2}]),
        ([0, 0x0001000100010001], 4, [{0, 1}]),
        ([5, None, 5], 0, [{0, 2}]),
        ([], 8, []),
    ],
)
def test_groups(spark, hashes, t, want):
    assert group_sets(similarity.groups(items(spark, hashes), t)) == want


def test_conflicts_and_diameter(spark):
    own = similarity.groups(items(spark, [0, 3, 0xFF]), 6)
    assert [tuple(r) for r in similarity.conflicts(own, 6).collect()] == [(0, 0, 2, 8, 6)]
    assert [tuple(r) for r in similarity.diameters(own).collect()] == [(0, 8)]


def test_pair_counters(spark):
    assert tuple(similarity.pair_counters(items(spark, [0, 0, 1]), 0).first()) == (3, 1)
    assert tuple(similarity.pair_counters(items(spark, []), 0).first()) == (0, 0)
    own = items(spark, [0] * 30 + [1] * 20 + [None, 255])
    want = {0: 30 * 29 // 2 + 20 * 19 // 2, 1: 600}
    assert {r.distance: r.pairs for r in similarity.pair_histogram(own, 3).collect()} == want
    assert tuple(similarity.pair_counters(own, 3).first()) == (51 * 50 // 2, sum(want.values()))


def test_large_groups_go_through_a_grid(spark, monkeypatch):
    monkeypatch.setattr(similarity, "GROUP_ROWS", 4)
    r = random.Random(4)
    rows = [(i, r.getrandbits(63), int(i >= 30)) for i in range(42)]
    own = spark.createDataFrame(rows, "item long, hash long, group_id long")
    far = lambda a, b: (a ^ b).bit_count()
    want = {g: max(far(a, b) for _, a, x in rows for _, b, y in rows if x == y == g) for g in (0, 1)}
    assert {x.group_id: x.diameter for x in similarity.diameters(own).collect()} == want
    found = sorted((x.first, x.second, x.distance) for x in similarity.conflicts(own, 30).select("first", "second", "distance").collect())
    assert found == [(i, j, far(a, b)) for i, a, x in rows for j, b, y in rows if i < j and x == y and far(a, b) > 30]


def test_export_numbers_within_names(spark):
    rows = [(i, f"p{i}", "a.cr2" if i % 3 else "b.cr2") for i in range(60)]
    plan = export.export_plan(spark.createDataFrame(rows, "group_id long, path string, file_name string")).collect()
    seen = {"a": 0, "b": 0}
    for x in sorted(plan):
        stem = "a" if x.group_id % 3 else "b"
        seen[stem] += 1
        assert x.target == (f"{stem}.cr2" if seen[stem] == 1 else f"{stem}-{seen[stem]}.cr2")
    assert len(plan) == 60


@pytest.mark.parametrize("t", [0, 1, 3, 4, 8, 11, 12, 20, 70])
@pytest.mark.parametrize("small", [False, True])
def test_pairs_are_exact(spark, monkeypatch, t, small):
    if small:
        monkeypatch.setattr(similarity, "BROADCAST_ROWS", 5)
        monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    r = random.Random(t)
    own = [r.getrandbits(64)]
    for _ in range(39):
        h = r.choice(own)
        for bit in r.sample(range(64), r.randint(0, 9)):
            h ^= 1 << bit
        own.append(h)
    own = [h - (1 << 64) if h >> 63 else h for h in own]
    got = sorted(tuple(x) for x in similarity.similar_pairs(items(spark, own), t).collect())
    far = lambda i, j: ((own[i] ^ own[j]) & (1 << 64) - 1).bit_count()
    assert got == [(i, j, far(i, j)) for i in range(40) for j in range(i + 1, 40) if far(i, j) <= t]


def test_bits_and_hex(spark):
    df = spark.createDataFrame([(0x123456789ABCDEF0, "123456789abcdef0"), (-1, "f" * 16), (None, "xyz")], "h long, t string")
    own = df.select(*(phash.band(F.col("h"), k) for k in range(4)), phash.hash_hex(F.col("h")), phash.hash_from_hex(F.col("t")), phash.hash_bit(F.col("h"), 0), phash.hash_bit(F.col("h"), 64), phash.hamming(F.col("h"), F.lit(0)))
    a, b, n = own.collect()
    assert tuple(a)[:4] == (0xDEF0, 0x9ABC, 0x5678, 0x1234) and a[4:6] == ("123456789abcdef0", 0x123456789ABCDEF0) and a[6] is False and a[7] is False
    assert b[4:6] == ("f" * 16, -1) and b[6] is True and b[8] == 64
    assert n[4] is None and n[5] is None


TIMES = {
    "2026:09:29 10:30:00": "2026-09-29T10:30:00",
    " 2026:09:29 10:30:00\0tail": "2026-09-29T10:30:00",
    "2026:02:31 00:00:00": "2026-02-31T00:00:00",
    **dict.fromkeys(["", "2026:09:29", "2026-09-29 10:30:00", "2026:13:01 00:00:00", "2026:00:01 00:00:00", "2026:01:32 00:00:00", "2026:01:00 00:00:00", "2026:01:01 24:00:00", "2026:01:01 00:60:00", "2026:01:01 00:00:60", "abcd:01:01 00:00:00", "2026:01:01T00:00:00", "2026:01:01 00:00:000", "٢٠٢٦:01:01 00:00:00", "2026:01:01 00:00:00\n."]),
}


def test_times(spark):
    df = spark.createDataFrame([(k, v) for k, v in TIMES.items()], "raw string, want string").withColumn("got", photo.capture_time(F.col("raw")))
    assert [r.raw for r in df.collect() if r.got != r.want] == []
    gap = spark.range(1).select(photo.seconds_between(F.lit("2026-02-28T00:00:00"), F.lit("2026-03-01T00:00:00")), photo.seconds_between(F.lit("2026-01-01T00:00:10"), F.lit("2026-01-01T00:00:00"))).first()
    assert tuple(gap) == (345600, -10)


def test_names(spark):
    paths = {"a/b.CR2": "cr2", "a.b/c": None, ".cr2": None, "x/.cr2": None, "x.tar.GZ": "gz", "x.": None, "_DSC1.ARW": "arw"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", photo.extension(F.col("p")).alias("e"), photo.accepted(F.col("p")).alias("a")).collect()
    assert {r.p: r.e for r in got} == paths and {r.p for r in got if r.a} == {"a/b.CR2", "_DSC1.ARW"}


def test_entries(spark):
    df = spark.sql("SELECT array(named_struct('tag', 1, 'type', 7, 'v', 'a'), named_struct('tag', 1, 'type', 2, 'v', 'b')) AS exif, array(named_struct('tag', 2, 'type', 2, 'v', 'c')) AS main")
    e, m = F.col("exif"), F.col("main")
    got = df.select(photo.entry_of(e, m, [2, 1])["v"], photo.entry_of(e, m, [3]), photo.has_tag(e, 1), photo.tags(m), photo.saturated(F.lit(70000))).first()
    assert tuple(got) == ("c", None, True, [2], 65535)


def score_of(spark, exposure, iso, focal, w, h, orientation=1, bias=None, own=None):
    aspect = photo.aspect(F.lit(w), F.lit(h), F.lit(orientation))
    lit = lambda v: F.lit(v).cast("double")
    return spark.range(1).select(score.score_struct(lit(exposure), lit(focal), F.lit(iso).cast("int"), aspect, F.lit(orientation), lit(bias), own or Settings()).alias("s")).first().s


def test_golden_scores(spark):
    s = score_of(spark, 1 / 400, 200, 40, 6000, 4000)
    assert [round(c.score, 2) for c in s.components] == [10.73, 72.60, 24.57, 100, 100] and round(s.total, 3) == 58.826
    s = score_of(spark, 0.001666, 300, 45, 6000, 4000)
    assert [round(c.score, 2) for c in s.components] == [20.49, 62.85, 30.23, 100, 97.14] and round(s.total, 3) == 59.454
    assert score_of(spark, 0.002, 200, 50, 4000, 3000).components[0].rationale == "1/500 s, 50 mm -> hareket riski"
    s = score_of(spark, None, 100, None, 4000, 0, 6, bias=-0.5)
    assert s.n_components == 2 and [c.score is None for c in s.components] == [True, False, True, True, False]
    assert s.components[1].rationale == "ISO 100 (poz telafisi -0.5 EV) -> ışık" and s.components[3].rationale == "en-boy oranı geçersiz"
    assert score_of(spark, None, None, None, None, None).total == 0.0


def test_component_by_name(spark):
    df = spark.range(1).select(F.struct(F.array(F.struct(F.lit("iso_dengesi").alias("name"), F.lit(1.5).alias("score"))).alias("components")).alias("s"))
    assert tuple(df.select(score.component(F.col("s"), "iso_dengesi")["score"], score.component(F.col("s"), "none")).first()) == (1.5, None)


def test_strongest(spark):
    lit = lambda v: F.lit(v).cast("double")
    own = dict(zip(score.NAMES, map(lit, [1, 5, None, 5, 2]), strict=True))
    none = dict.fromkeys(score.NAMES, lit(None))
    assert tuple(spark.range(1).select(score.strongest(own), score.strongest(none), score.taking_part(own)).first()) == ("kompozisyon", None, 4)


def test_settings(tmp_path):
    assert math.isclose(Settings().weight_sum(), 1) and settings.from_mapping({}) == Settings()
    assert settings.from_mapping({"agirlik_keskinlik": 0.5, "other": 1}).sharpness == 0.5
    for bad in ({"agirlik_keskinlik": -1}, dict.fromkeys(list(settings.KEYS.values())[:5], 0), {"hedef_en_boy": 0}, {"iso_yeterli": 0}, {"agirlik_iso": "x"}, {"agirlik_iso": float("nan")}):
        with pytest.raises(errors.TriageError) as e:
            settings.from_mapping(bad)
        assert e.value.label == "ayar-gecersiz"
    path = tmp_path / "s.json"
    path.write_text("[")
    with pytest.raises(errors.TriageError):
        settings.load(str(path))
    assert settings.load(None) == Settings()


def test_export(tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    for folder in ("a", "b"):
        (root / folder).mkdir()
        (root / folder / "x.cr2").write_bytes(folder.encode() * 100_000)
    own = {"kok": str(root), "gruplar": [{"kimlik": i, "oneri": str(root / f / "x.cr2"), "uyeler": [{"toplam_puan": 1.0}]} for i, f in enumerate("ab")]}
    assert [(n, s) for n, _, s, _ in export.export(own, str(out))] == [(0, 100_000), (1, 100_000)]
    assert sorted(p.name for p in out.iterdir()) == ["x-2.cr2", "x.cr2"] and (root / "a" / "x.cr2").exists()
    assert len(export.export(own, str(out), only=1)) == 1
    for bad in (root, root / "below", tmp_path, str(root).upper(), root / ".." / "in"):
        with pytest.raises(errors.TriageError) as e:
            export.export(own, str(bad))
        assert e.value.label == "hedef-cakisti"
    with pytest.raises(errors.TriageError):
        export.copy_file(str(root / "none"), str(out / "none"))
    assert not list(out.glob("*.gecici"))


def test_report_file(tmp_path):
    path = tmp_path / "r.json"
    for text in ("{", "[]", json.dumps({"kok": "x"})):
        path.write_text(text)
        with pytest.raises(errors.TriageError) as e:
            report.read_report(str(path))
        assert e.value.label == "parametre"


def test_dense_numbers(spark):
    df = spark.createDataFrame([(f"{i * 7919 % 1000:04}",) for i in range(1000)] + [("0005",)], "k string")
    got = similarity.dense_numbers(df, "k", "n").collect()
    assert [r.n for r in sorted(got)] == list(range(1000))


@pytest.mark.parametrize("t", [0, 3, 4, 8, 11])
def test_bands_and_their_bound(spark, t):
    r = random.Random(t)
    own = [r.getrandbits(63) for _ in range(30)]
    own += [h ^ sum(1 << i for i in r.sample(range(63), t)) for h in own]
    distinct = items(spark, sorted(set(own))).select("hash")
    far = lambda a, b: (a ^ b).bit_count()
    got = sorted(tuple(x) for x in similarity._banded(distinct, t).collect())
    assert got == [(a, b) for a, b in sorted((min(a, b), max(a, b)) for a in set(own) for b in set(own) if a < b) if far(a, b) <= t]
    bands, errors = similarity.band_plan(t)
    parts = lambda h: [h >> 64 * k // bands & (1 << 64 // bands) - 1 for k in range(bands)]
    candidates = sum(far(x, y) <= errors for a in set(own) for b in set(own) for x, y in zip(parts(a), parts(b), strict=True))
    assert similarity.band_candidates(distinct, t) >= candidates


def test_unselective_bands_go_by_blocks(spark, monkeypatch):
    """Half of the bits are always 0, as in banded_pairs_t8: no band is made, and the pairs are all there."""
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 300)
    monkeypatch.setattr(similarity, "_banded", None)
    r = random.Random(8)
    own = sorted({r.getrandbits(64) & 0x00FF00FF00FF00FF for _ in range(1000)})
    got = sorted(tuple(x) for x in similarity.hash_pairs(items(spark, own), 8).collect())
    assert got == [(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if (a ^ b).bit_count() <= 8] and got


def test_selective_bands_stay(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(similarity, "_grid", None)
    own = [7**22 * i % 2**63 for i in range(1, 500)]
    assert similarity.hash_pairs(items(spark, own + [own[0] ^ 5]), 3).count() == 1


@pytest.mark.parametrize("rows", [3, 8192])
def test_diameters_of_negative_and_equal_hashes(spark, monkeypatch, rows):
    monkeypatch.setattr(similarity, "GROUP_ROWS", rows)
    own = spark.createDataFrame([(0, -1, 5), (1, 0, 5), (2, 0, 5), (3, -1, 5), (4, 9, 6), (5, 9, 6), (6, 1, 7), (7, 2, 7), (8, -(2**63), 7)], "item long, hash long, group_id long")
    assert {x.group_id: x.diameter for x in similarity.diameters(own).collect()} == {5: 64, 6: 0, 7: 2}
    assert similarity.diameters(own.where("false")).count() == 0
    assert "MapInArrow" in similarity.diameters(own)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [3, 8192])
def test_conflicts_of_repeated_hashes(spark, monkeypatch, rows):
    monkeypatch.setattr(similarity, "GROUP_ROWS", rows)
    r = random.Random(rows)
    own = [(i, r.choice([0, 1, 7, -1, 255]), int(i > 20)) for i in range(30)] + [(30, 3, 2), (31, 3, 2)]
    df = spark.createDataFrame(own, "item long, hash long, group_id long")
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = [(g, i, j, far(a, b), 6) for i, a, g in own for j, b, x in own if i < j and g == x and far(a, b) > 6]
    assert sorted(tuple(x) for x in similarity.conflicts(df, 6).select("group_id", "first", "second", "distance", "threshold").collect()) == want


@pytest.mark.parametrize("rows", [3, 8192])
def test_conflicted_without_conflicts(spark, monkeypatch, rows):
    """The groups with a conflict, without the pairs being made."""
    monkeypatch.setattr(similarity, "GROUP_ROWS", rows)
    monkeypatch.setattr(similarity, "conflicts", None)
    own = [(i, h, g) for i, (h, g) in enumerate([(h, 0) for h in range(16)] + [(0, 1), (-1, 1), (0, 1), (5, 2), (5, 2), (9, 3)])]
    df = spark.createDataFrame(own, "item long, hash long, group_id long")
    assert [[x.group_id for x in similarity.conflicted(df, t).orderBy("group_id").collect()] for t in (3, 4, 63, 64, 70)] == [[0, 1], [1], [1], [], []]


def test_group_facts_are_those_of_the_report(spark, monkeypatch):
    """Also where paths repeat: each frame has a place of its own. No members are gathered."""
    parts = ", ".join(f"named_struct('name', '{n}', 'score', 1.0D, 'weight', 0.2D, 'rationale', '')" for n in score.NAMES)
    total = f"named_struct('components', array({parts}), 'total', CAST(id % 7 AS DOUBLE), 'n_components', 5)"
    frames = spark.range(40).selectExpr("concat('p', lpad(CAST(id % 25 AS STRING), 2, '0')) AS path", "'x.cr2' AS file_name", "CASE WHEN id % 3 = 0 THEN (id DIV 9) * 255 END AS hash", f"{total} AS score")
    want = report.report_groups(frames, 4).selectExpr("group_id", "n_members", "diameter", "conflicted").collect()
    assert sum(x.n_members for x in want) == 40 and sorted(x.group_id for x in want) == list(range(len(want)))
    assert sum(x.n_members == 1 for x in want) >= 26  # 26 frames have no hash
    monkeypatch.setattr(report, "grouped", None)
    got = report.group_facts(frames, 4).select("group_id", "n_members", "diameter", "conflicted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "score" not in got._jdf.queryExecution().optimizedPlan().toString()
