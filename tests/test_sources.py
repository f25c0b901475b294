"""Listing, TIFF, previews, JPEG, hashes, the whole scan and the command line, on synthetic files."""

import dataclasses
import io
import json
import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frametriage import cli, errors
from frametriage.functions import phash
from frametriage.operators import report
from frametriage.plans import triage
from frametriage.sources import frames, jpeg, listing, samples
from frametriage.sources.samples import Sample, gray_jpeg, pattern
from frametriage.streaming.scoring import scored_stream


def test_listing(spark, tmp_path):
    for name in ("a.CR2", "_DSC0001.ARW", ".git/x.cr2", "sub/.hidden.nef", "sub/deep/b.dng", "sub/c.txt", ".cr2"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    os.symlink(tmp_path / "a.CR2", tmp_path / "link.cr2")
    os.symlink(tmp_path / "sub", tmp_path / "loop")
    for front in (256, 1):
        listing.FRONT = front
        own = listing.list_tree(spark, str(tmp_path)).cache()
        assert sorted(os.path.basename(r.path) for r in listing.files_of(own).collect()) == [".hidden.nef", "_DSC0001.ARW", "a.CR2", "b.dng"]
        assert tuple(listing.counters(own).first()) == (4, 3, 1, 0)
    listing.FRONT = 256
    with pytest.raises(Exception, match="not a directory"):
        listing.list_tree(spark, str(tmp_path / "a.CR2"))


@pytest.mark.parametrize("name", ["flat", "vertical", "horizontal", "checker", "radial"])
@pytest.mark.parametrize(("side", "restart"), [(64, 0), (61, 3), (8, 0)])
def test_jpeg_round_trip(name, side, restart):
    image = pattern(name, side)
    assert np.abs(jpeg.luma(gray_jpeg(image, restart)).astype(int) - image).max() <= 2


def plain_luma(image, steps, rows, columns):
    """What is left of the first plane after quantising, block by block from the formulas."""
    x = np.arange(8)
    basis = np.array([[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * i + 1) * u * np.pi / 16) for i in x] for u in x])
    padded = np.pad(image.astype(float), ((0, rows - image.shape[0]), (0, columns - image.shape[1])), mode="edge") - 128
    out = np.zeros_like(padded)
    for r in range(0, rows, 8):
        for k in range(0, columns, 8):
            f = np.rint(basis @ padded[r : r + 8, k : k + 8] @ basis.T / steps.reshape(8, 8)) * steps.reshape(8, 8)
            out[r : r + 8, k : k + 8] = basis.T @ f @ basis + 128
    return np.clip(out, 0, 255)[: image.shape[0], : image.shape[1]]


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (1, 2), (2, 2), (4, 1)])
@pytest.mark.parametrize(("shape", "restart"), [((64, 64), 0), ((37, 53), 2), ((8, 8), 0), ((9, 100), 1)])
def test_color_jpeg(sampling, shape, restart):
    image = np.random.default_rng(7).integers(0, 256, shape).astype(np.uint8)
    steps = samples.camera_steps()
    assert len(set(steps[0].tolist())) > 8 and (steps[0].reshape(8, 8) != steps[0].reshape(8, 8).T).any()
    got = jpeg.luma(samples.color_jpeg(image, sampling, restart)).astype(float)
    h, v = sampling
    want = plain_luma(image, steps[0], -(-shape[0] // (8 * v)) * 8 * v, -(-shape[1] // (8 * h)) * 8 * h)
    assert got.shape == shape and np.abs(got - want).max() <= 0.51


def test_strict_hash_and_streams():
    assert phash.strict_hash(pattern("checker")) == phash.hash_of(pattern("checker"))
    with pytest.raises(errors.TriageError) as e:
        phash.strict_hash(pattern("flat", 7))
    assert e.value.label == "onizleme-bozuk"

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 3))

    assert frames.read_stream(Slow(b"0123456789"), 8, "x") == b"01234567"
    with pytest.raises(errors.TriageError) as e:
        frames.read_stream(Slow(b"0123"), 8, "x")
    assert e.value.label == "onizleme-bozuk" and "4 read" in str(e.value)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 40), st.integers(1, 40), st.integers(0, 4))
def test_jpeg_of_noise(seed, height, width, restart):
    image = np.random.default_rng(seed).integers(0, 256, (height, width)).astype(np.uint8)
    assert np.abs(jpeg.luma(gray_jpeg(image, restart)).astype(int) - image).max() <= 3


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.binary(min_size=1, max_size=3), st.integers(0, 600))
def test_broken_jpegs_only_raise_their_error(at, new, cut):
    data = gray_jpeg(pattern("checker", 16))
    data = data[:at] + new + data[at + len(new) :]
    for own in (data, data[:cut]):
        try:
            jpeg.luma(own)
        except jpeg.JpegError:
            pass


def test_dct_and_hash():
    r = np.random.default_rng(1)
    cells = r.uniform(0, 255, (5, 64))
    x = np.arange(8)
    scale = np.where(x == 0, 0.5**0.5, 1)
    for row, got in zip(cells, phash.coefficients(cells), strict=True):
        f = row.reshape(8, 8)
        want = [[0.25 * scale[u] * scale[v] * sum(f[b, a] * np.cos((2 * a + 1) * u * np.pi / 16) * np.cos((2 * b + 1) * v * np.pi / 16) for a in x for b in x) for u in x] for v in x]
        assert np.allclose(got, np.ravel(want)) and np.isclose((got**2).sum(), (row**2).sum())
    flat = phash.coefficients(np.full((1, 64), 100.0))[0]
    assert np.isclose(flat[0], 800) and np.allclose(flat[1:], 0)
    assert phash.hash_of(pattern("flat", gray=9)) == 0 and phash.hash_of(pattern("flat", 7)) is None
    assert (phash.hashes(cells) == phash.hashes(cells + 40)).all() and (phash.hashes(cells) >= 0).all()
    assert f"{phash.hash_of(pattern('radial')):016x}" == "157f7fff7fff7fff"


@pytest.mark.parametrize(("height", "width"), [(8, 8), (9, 23), (64, 17), (100, 100)])
def test_boxes(height, width):
    image = np.random.default_rng(2).integers(0, 256, (height, width))
    want = [image[b * height // 8 : (b + 1) * height // 8, a * width // 8 : (a + 1) * width // 8].mean() for b in range(8) for a in range(8)]
    assert np.allclose(phash.cells_of(image), want)


def test_brightness():
    image = pattern("flat", gray=7)
    assert frames.brightness(image) == 7 and frames.brightness(image[:0]) == 0
    assert frames.pixel(image, 0, 0) == 7 and frames.pixel(image, -1, 0) == 0 and frames.pixel(image, 64, 0) == 0


def test_decoded_fields():
    row = frames.decode("x/sony.arw", samples.byte_samples()["sony.arw"])
    assert (row["make"], row["width"], row["height"], row["orientation"], row["iso"]) == ("Sony", 7008, 4672, 6, 100)
    assert row["file_name"] == "sony.arw" and row["preview_bytes"] and row["error"] is None
    plain = frames.decode("x", Sample(pad=2 << 20).to_bytes())
    assert plain["bytes_read"] < 2048 and plain["file_size"] == 2 << 20 and plain["preview_bytes"] is None
    assert frames.decode("x", Sample(preview=gray_jpeg(pattern("checker"))).to_bytes(), hashing=False)["hash"] is None
    assert frames.decode("x", Sample(width=100_000).to_bytes())["width"] == 65535
    none = frames.decode("x", Sample(captured=None, exposure=None, aperture=None, iso=None, focal=None, orientation=None, width=None, height=None).to_bytes())
    assert none["error"] is None and none["iso"] is None and none["make"] == "Canon"
    assert frames.decode("/none/there")["error"] == "io"


def test_no_byte_string_escapes_the_decoder():
    r = np.random.default_rng(3)
    data = samples.byte_samples()["canon.cr2"]
    for _ in range(400):
        own = bytearray(data)
        for at in r.integers(0, len(own), 4):
            own[at] = r.integers(0, 256)
        frames.decode("x", bytes(own[: r.integers(0, len(own) + 1)]))


def test_scan_report_export(spark, tmp_path):
    root, out = tmp_path / "demo", tmp_path / "out"
    samples.demo_folder(str(root))
    found = triage.scan(spark, str(root))
    s = found.statistics().first()
    assert (s.found, s.meta_read, s.preview_found, s.hashed, s.skipped) == (10, 9, 9, 9, 1) and s.bytes_total == 9 * (2 << 20)
    assert s.bytes_read / s.bytes_total < 0.005
    text = json.loads(triage.judge(found, 8))
    assert [len(g["uyeler"]) for g in text["gruplar"]] == [3, 3, 3] and all(g["en_uzak_mesafe"] == 0 and not g["cakismali"] for g in text["gruplar"])
    assert all(g["oneri"] == max(g["uyeler"], key=lambda m: m["toplam_puan"])["yol"] == g["uyeler"][0]["yol"] for g in text["gruplar"]) and text["atlanan"][0]["hata"] == "tiff-bazli-degil"
    assert triage.group(found, 8).select("group_id").distinct().count() == 3
    path = tmp_path / "r.json"
    path.write_text(json.dumps(text))
    members = report.members_of_report(spark, str(path)).collect()
    assert sorted(m.path for m in members) == sorted(r.path for r in found.frames.collect()) and all(m.hash >= 0 and m.total > 0 for m in members)
    saved = str(tmp_path / "saved")
    report.save_report(saved, str(root), 8, found.frames, found.skipped)
    assert sorted(map(tuple, report.saved_members(spark, saved).collect())) == sorted(map(tuple, members))
    lines = [json.loads(x) for part in sorted((tmp_path / "saved" / "gruplar").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines == text["gruplar"]
    assert json.loads("".join(p.read_text() for p in (tmp_path / "saved" / "baslik").glob("part-*"))) == {k: v for k, v in text.items() if k not in ("gruplar", "atlanan")}
    assert cli.main(["export", str(path), str(out)]) == 0 and len(list(out.iterdir())) == 3
    assert cli.main(["export", str(path), str(root)]) == 1
    flat = triage.scan(spark, str(root), hashing=False).statistics().first()
    assert (flat.preview_missing, flat.hashed) == (9, 0)


def test_report_flags_conflicts_after_a_frame_without_hash(spark):
    score = "named_struct('components', array(named_struct('name', 'x', 'score', 1D, 'weight', 1D, 'rationale', '')), 'total', {}D, 'n_components', 1)"
    rows = [("a", "NULL", 1), ("b", "0", 2), ("c", "3", 3), ("d", "255", 3)]
    df = spark.sql(" UNION ALL ".join(f"SELECT '{p}' AS path, '{p}' AS file_name, CAST({h} AS BIGINT) AS hash, {score.format(s)} AS score" for p, h, s in rows))
    got = {r.group_id: (r.recommended, r.conflicted, r.diameter, r.n_members) for r in report.report_groups(df, 6).collect()}
    assert got == {0: ("c", True, 8, 3), 1: ("a", False, 0, 1)}


def test_commands(spark, tmp_path, capsys):
    root = tmp_path / "demo"
    made = samples.demo_folder(str(root), 3, 4096)
    assert cli.main(["group", str(root), "--esik", "65"]) == 1
    assert cli.main(["group", str(root), "--onizleme-istatistik", "--cikti", str(tmp_path / "r.json")]) == 0
    said = capsys.readouterr().out
    assert "skipped: " in said and json.loads((tmp_path / "r.json").read_text())["esik"] == 8
    bad = tmp_path / "bad.json"
    bad.write_text('{"agirlik_keskinlik": -1.0}')
    assert cli.main(["judge", str(root), "--ayar", str(bad)]) == 1
    assert cli.main(["judge", str(root), "--cikti", str(tmp_path / "j.json")]) == 0
    assert cli.main(["info", made[0], "--onizleme-yaz", str(tmp_path / "p.jpg")]) == 0
    assert (tmp_path / "p.jpg").read_bytes()[:2] == b"\xff\xd8"
    assert cli.main(["info", str(root / "broken.cr2")]) == 1


def test_data_source(spark, tmp_path):
    samples.demo_folder(str(tmp_path / "d"), 3, 4096)
    spark.dataSource.register(frames.FrameFiles)
    own = spark.read.format("frames").option("path", str(tmp_path / "d")).load()
    assert own.count() == 4 and own.where("hash is not null").count() == 3
    before, listing.FRONT = listing.FRONT, 1
    try:
        samples.demo_folder(str(tmp_path / "d" / "e" / "f"), 3, 4096)
        reader = frames._Reader({"path": str(tmp_path)})
        found = [row["path"] for p in reader.partitions() for batch in reader.read(p) for row in batch.to_pylist()]
        assert len(found) == len(set(found)) == 8
    finally:
        listing.FRONT = before


def test_stream(spark, tmp_path):
    samples.demo_folder(str(tmp_path / "d"), 3, 4096)
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "d"))
    q = scored_stream(stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from scored where hash is not null").count() == 3


def test_presets():
    row = frames.decode("n", dataclasses.replace(samples.NIKON, order=">").to_bytes())
    assert struct.unpack("f", struct.pack("f", row["exposure_s"]))[0] > 0 and row["iso"] == 400
