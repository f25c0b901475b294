"""Command line: group, judge, export, info."""

from __future__ import annotations

import argparse
import sys

from . import errors, settings
from .operators import export, report, similarity
from .operators.report import VERSION


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("frametriage").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def group(own: argparse.Namespace) -> None:
    from .plans import triage

    triage.check_threshold(own.esik)
    found = triage.scan(session(), own.root, hashing=not own.hash_yok)
    s = found.statistics().first()
    membership = triage.group(found, own.esik)
    far = similarity.conflicted(membership, own.esik)
    lines = {
        "root": own.root,
        "threshold": own.esik,
        "files": s.found,
        "bytes read": f"{s.bytes_read} / {s.bytes_total} ({100 * s.bytes_read / s.bytes_total if s.bytes_total else 0:.4f}%)",
        "previews": f"{s.preview_found} found, {s.preview_missing} missing",
        "hashes": s.hashed,
        "skipped": s.skipped,
        "groups": membership.select("group_id").distinct().count(),
        "conflicted groups": similarity.conflicted_groups(far).first()[0],
    }
    print(f"frametriage {VERSION}: group")
    for name, value in lines.items():
        print(f"  {name:<18}: {value}")
    if own.onizleme_istatistik:
        for row in found.skipped.orderBy("path").limit(5).collect():
            print(f"    skipped: {row.path} ({row.error})")
    if own.cikti:
        triage.judge(found, own.esik, own.cikti)
        print(f"  {'report':<18}: {own.cikti}")


def judge(own: argparse.Namespace) -> None:
    from .plans import triage

    triage.check_threshold(own.esik)
    text = triage.judge(triage.scan(session(), own.root, settings.load(own.ayar)), own.esik, own.cikti)
    print(f"report written: {own.cikti}" if own.cikti else text, file=sys.stderr if own.cikti else sys.stdout)


def export_files(own: argparse.Namespace) -> None:
    done = export.export(report.read_report(own.report), own.destination, own.grup)
    for number, target, size, points in done:
        print(f"group {number:>3} -> {target} ({size} bytes, {points:.1f} points)")
    print(f"{len(done)} frames exported")


def info(own: argparse.Namespace) -> None:
    from .sources.frames import decode, decode_files, frames_of

    row = decode(own.file)
    if row["error"] is not None:
        raise errors.TriageError(row["error"], own.file, row["detail"])
    spark = session()
    frame = frames_of(decode_files(spark.createDataFrame([(own.file,)], "path string"))).first()
    m = frame.meta
    show = lambda x, form="{}": "-" if x is None else form.format(x)
    lines = {
        "file": frame.path,
        "size": f"{frame.file_size} bytes",
        "read": f"{frame.bytes_read} bytes ({100 * frame.bytes_read / frame.file_size:.4f}%)",
        "camera": f"{show(m.make)} {show(m.model)}",
        "captured": show(m.capture_time),
        "exposure": f"{'1/' + format(1 / m.exposure_s, '.0f') if m.exposure_s else '-'} f/{show(m.f_number, '{:.1f}')} ISO {show(m.iso)}",
        "focal length": f"{show(m.focal_mm, '{:.0f}')} mm",
        "size, orientation": f"{show(m.width)}x{show(m.height)} {show(m.orientation)}",
        "aspect": show(m.aspect),
        "preview": f"{'yes' if frame.has_preview else 'no'} ({show(frame.preview_bytes)} bytes)",
        "hash": show(frame.hash, "{:016x}"),
        "score": f"{frame.score.total:.1f}",
    }
    for name, value in lines.items():
        print(f"{name:<18}: {value}")
    for c in frame.score.components:
        print(f"  - {c.name:<12} {show(c.score, '{:.1f}'):>6}  (weight {c.weight:.2f}) {c.rationale}")
    if own.onizleme_yaz:
        if row["preview_bytes"] is None:
            raise errors.TriageError(errors.NO_PREVIEW, own.file)
        print(f"{'preview written':<18}: {write_preview(own.file, row['preview_offset'], row['preview_bytes'], own.onizleme_yaz)} bytes")


def write_preview(path: str, offset: int, length: int, target: str) -> int:
    """Copies the preview's bytes to a file, a chunk at a time."""
    import os

    try:
        with open(path, "rb") as a, open(target, "wb") as b:
            a.seek(offset)
            left = length
            while left:
                data = a.read(min(left, export.CHUNK))
                if not data:
                    raise errors.TriageError(errors.BROKEN_PREVIEW, path, "ends early")
                b.write(data)
                left -= len(data)
            b.flush()
            os.fsync(b.fileno())
    except OSError as e:
        raise errors.TriageError(errors.IO, target, str(e)) from e
    return length


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="frametriage", description="Triage of photo bursts.")
    out.add_argument("--version", action="version", version=VERSION)
    commands = out.add_subparsers(required=True)
    p = commands.add_parser("group", help="scan a folder and count similar groups")
    p.add_argument("root")
    p.add_argument("--esik", type=int, default=8, help="bits that similar hashes may differ in")
    p.add_argument("--cikti", help="also write a report")
    p.add_argument("--hash-yok", action="store_true", help="without previews and hashes")
    p.add_argument("--onizleme-istatistik", action="store_true", help="show up to five skipped files")
    p.set_defaults(run=group)
    p = commands.add_parser("judge", help="write a report with a recommendation for each group")
    p.add_argument("root")
    p.add_argument("--esik", type=int, default=8)
    p.add_argument("--cikti")
    p.add_argument("--ayar", help="settings as JSON")
    p.set_defaults(run=judge)
    p = commands.add_parser("export", help="copy the recommended files of a report")
    p.add_argument("report")
    p.add_argument("destination")
    p.add_argument("--grup", type=int, help="this group only")
    p.set_defaults(run=export_files)
    p = commands.add_parser("info", help="show one file")
    p.add_argument("file")
    p.add_argument("--onizleme-yaz", help="write the preview to a file")
    p.set_defaults(run=info)
    return out


def main(argv: list[str] | None = None) -> int:
    own = parser().parse_args(argv)
    try:
        own.run(own)
    except errors.TriageError as e:
        print(f"hata: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
