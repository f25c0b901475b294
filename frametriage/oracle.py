"""DuckDB SQL for the queries."""

from __future__ import annotations

from .functions.photo import EXTENSIONS
from .queries import SHOTS

_SHOTS = SHOTS.format(orders="orders").replace("AS STRING", "AS VARCHAR")
_HASH = """
coef AS (
  SELECT e.vec_id, i.i, sum(e.embedding[j.j + 1]::DOUBLE
      * (CASE WHEN i.i % 8 = 0 THEN sqrt(0.5) ELSE 1 END) * (CASE WHEN i.i // 8 = 0 THEN sqrt(0.5) ELSE 1 END) * 0.25
      * cos((2 * (j.j % 8) + 1) * (i.i % 8) * pi() / 16) * cos((2 * (j.j // 8) + 1) * (i.i // 8) * pi() / 16)) AS v
  FROM embeddings e, range(64) i(i), range(64) j(j) GROUP BY e.vec_id, i.i
), mean AS (SELECT vec_id, avg(v) AS m FROM coef WHERE i > 0 GROUP BY vec_id
), h AS (
  SELECT vec_id, CAST(coalesce(sum(CASE WHEN i > 0 AND v > m + 1e-9 THEN CAST(1 AS BIGINT) << (63 - greatest(i, 1)) ELSE 0 END), 0) AS BIGINT) AS hash
  FROM coef JOIN mean USING (vec_id) GROUP BY vec_id
)"""
_PAIRS = _HASH + """, pairs AS (
  SELECT a.vec_id AS first, b.vec_id AS second, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance
  FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.hash, b.hash)) <= 18
)"""
_GROUPS = _PAIRS + """, links AS (SELECT first AS a, second AS b FROM pairs UNION ALL SELECT second, first FROM pairs
), reach(a, b) AS (SELECT vec_id, vec_id FROM h UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a
), root AS (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a
), grp AS (SELECT vec_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS group_id FROM root
), far AS (
  SELECT x.group_id, x.vec_id AS first, y.vec_id AS second, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance
  FROM grp x JOIN grp y ON x.group_id = y.group_id AND x.vec_id < y.vec_id JOIN h a ON a.vec_id = x.vec_id JOIN h b ON b.vec_id = y.vec_id
)"""
_TIME = f"""
s AS ({_SHOTS}), t AS (
  SELECT *, CASE WHEN regexp_full_match(capture_raw, '[0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')
    THEN concat(substr(capture_raw, 1, 4), '-', substr(capture_raw, 6, 2), '-', substr(capture_raw, 9, 2), 'T', substr(capture_raw, 12, 8)) END AS capture_time FROM s
)"""


def _epoch(c: str) -> str:
    part = lambda at, n: f"CAST(substr({c}, {at}, {n}) AS BIGINT)"
    y = f"({part(1, 4)} - 1970)"
    return f"((366 * (365 * {y} + {y} // 4 - {y} // 100 + {y} // 400) + 31 * ({part(6, 2)} - 1) + {part(9, 2)} - 1) * 86400 + {part(12, 2)} * 3600 + {part(15, 2)} * 60 + {part(18, 2)})"


_CLAMP = "least(greatest({}, 0), 100)".format
_SCORES = f"""
s AS ({_SHOTS}), o AS (
  SELECT *, CASE WHEN orientation BETWEEN 5 AND 8 THEN height ELSE width END AS w, CASE WHEN orientation BETWEEN 5 AND 8 THEN width ELSE height END AS h,
    CASE WHEN exposure_den <> 0 THEN CAST(exposure_num AS DOUBLE) / exposure_den END AS e FROM s
), p AS (SELECT *, CASE WHEN h <> 0 THEN CAST(w AS DOUBLE) / h END AS aspect FROM o
), k AS (
  SELECT *,
    CASE WHEN e > 0 AND focal_mm > 0 THEN {_CLAMP("(log2(1 / e) + 1.5 * greatest(log2(focal_mm / 50.0), 0) - 8) * 100 / 6")} END AS sharpness,
    CASE WHEN iso > 0 THEN {_CLAMP("(12 - log2(iso)) * 100 / 6")} END AS exposure,
    CASE WHEN focal_mm > 0 THEN {_CLAMP("log2(focal_mm / 24.0) * 100 / 3")} END AS crop,
    CASE WHEN aspect > 0 THEN {_CLAMP("100 * exp(-abs(ln(aspect) - ln(1.5)) / 0.35)")} END AS composition,
    CASE WHEN iso > 0 THEN {_CLAMP("(16 - log2(iso)) * 100 / 8")} END AS iso_balance
  FROM p
), w AS (
  SELECT *, coalesce(sharpness * 0.3, 0) + coalesce(exposure * 0.25, 0) + coalesce(crop * 0.1, 0) + coalesce(composition * 0.2, 0) + coalesce(iso_balance * 0.15, 0) AS points,
    (sharpness IS NOT NULL)::INT * 0.3::DOUBLE + (exposure IS NOT NULL)::INT * 0.25::DOUBLE + (crop IS NOT NULL)::INT * 0.1::DOUBLE
      + (composition IS NOT NULL)::INT * 0.2::DOUBLE + (iso_balance IS NOT NULL)::INT * 0.15::DOUBLE AS weight,
    (sharpness IS NOT NULL)::INT + (exposure IS NOT NULL)::INT + (crop IS NOT NULL)::INT + (composition IS NOT NULL)::INT + (iso_balance IS NOT NULL)::INT AS n
  FROM k
), f AS (SELECT *, round(CASE WHEN weight > 0 THEN points / weight ELSE 0 END, 4) AS total, split_part(path, '/', 2) AS name FROM w
), x AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(split_part(name, '.', 2)) END AS ext FROM f)"""
_ACCEPTED = f"coalesce(ext IN ({', '.join(repr(e) for e in EXTENSIONS)}), false)"
_FRAMES = f"{_GROUPS}, {_SCORES}, fr AS (SELECT x.*, h.hash FROM x LEFT JOIN h ON h.vec_id = x.shot_id)"
_STATS = f"""SELECT count(*) AS found, count(*) FILTER ({_ACCEPTED}) AS meta_read, count(*) FILTER ({_ACCEPTED} AND hash IS NOT NULL) AS preview_found,
  count(*) FILTER ({_ACCEPTED} AND hash IS NULL) AS preview_missing, CAST(0 AS BIGINT) AS preview_broken, count(*) FILTER ({_ACCEPTED} AND hash IS NOT NULL) AS hashed,
  count(*) FILTER (NOT {_ACCEPTED}) AS skipped, CAST(sum(bytes_read) FILTER ({_ACCEPTED}) AS BIGINT) AS bytes_read, CAST(sum(file_size) FILTER ({_ACCEPTED}) AS BIGINT) AS bytes_total FROM fr"""
# Frames are numbered in order of path here, so the groups are made anew on those numbers.
_REPORT = f"""WITH RECURSIVE {_HASH}, {_SCORES},
fr AS (SELECT x.*, h.hash, row_number() OVER (ORDER BY path) AS item FROM x LEFT JOIN h ON h.vec_id = x.shot_id),
hs AS (SELECT item, hash FROM fr WHERE hash IS NOT NULL),
pr AS (SELECT a.item AS a, b.item AS b FROM hs a JOIN hs b ON a.item <> b.item WHERE bit_count(xor(a.hash, b.hash)) <= 18),
reach(a, b) AS (SELECT item, item FROM hs UNION SELECT r.a, e.b FROM reach r JOIN pr e ON r.b = e.a),
root AS (SELECT a AS item, min(b) AS root FROM reach GROUP BY a),
gr AS (SELECT item, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS group_id FROM root),
al AS (SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 + (SELECT coalesce(max(group_id) + 1, 0) FROM gr) AS BIGINT) AS group_id FROM fr WHERE hash IS NULL),
ds AS (SELECT x.group_id, max(bit_count(xor(a.hash, b.hash))) AS d FROM gr x JOIN gr y USING (group_id) JOIN hs a ON a.item = x.item JOIN hs b ON b.item = y.item GROUP BY x.group_id),
mb AS (SELECT * FROM gr UNION ALL SELECT * FROM al),
rep AS (SELECT m.group_id, first_value(path) OVER w AS recommended, coalesce(d > 18, false) AS conflicted, CAST(coalesce(d, 0) AS INTEGER) AS diameter,
  CAST(count(*) OVER (PARTITION BY m.group_id) AS INTEGER) AS n_members, CAST(row_number() OVER w - 1 AS INTEGER) AS place, path,
  CASE WHEN hash IS NOT NULL THEN printf('%016x', hash) END AS hash, total
FROM mb m JOIN fr USING (item) LEFT JOIN ds USING (group_id) WINDOW w AS (PARTITION BY m.group_id ORDER BY total DESC, path))"""
_BEST = f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY total DESC, path) AS place FROM x)"
#: Hashes of the synthetic patterns.
_CHECKER, _WIDE_CHECKER, _VERTICAL, _HORIZONTAL, _FLAT = "7ffaffeaffaaffaa", "7fafffaffffafffa", "2affffffffffffff", "7f7fff7fff7fff7f", "0" * 16


def _meta(name, make="Canon", model="NULL", e="0.002", f="2.8", iso=200, focal=50, orientation=1, width=4000, height=3000, aspect="1.333333"):
    crop = f"round(43.266 * {focal} / sqrt({width}::DOUBLE * {height}), 6)"
    return f"('{name}', '{make}', {model}, '2026-09-29T10:30:00', {e}::DOUBLE, {f}::DOUBLE, {iso}, {focal}::DOUBLE, {orientation}, {width}, {height}, {aspect}::DOUBLE, {crop})"


_K = "'Test Kamera'"
_TIFF = ", ".join(
    [
        *(_meta(n, model=_K) for n in ("big_endian.dng", "broken_preview.cr2", "canon.cr2", "color_420.cr2", "color_422.nef", "flat.cr2", "strip.tif")),
        "('circle.cr2', 'Canon', 'Test Kamera', NULL, NULL, NULL, NULL, NULL, 1, 4000, 3000, 1.333333, 0.0)",
        _meta("nikon.nef", "Nikon", _K, "0.001", "4", 400, 85, 1, 6048, 4024, "round(6048::DOUBLE / 4024, 6)"),
        _meta("sony.arw", "Sony", _K, "0.004", "5.6", 100, 35, 6, 7008, 4672, "round(4672::DOUBLE / 7008, 6)"),
        _meta("unknown_type.cr2", model="NULL"),
        _meta("zero_denominator.cr2", model=_K, e="NULL"),
    ]
)

ORACLE = {
    "phash_embeddings": f"WITH {_HASH} SELECT vec_id, hash, printf('%016x', hash) AS hash_hex FROM h",
    "dct_coefficients": f"WITH {_HASH} SELECT vec_id, CAST(i AS INTEGER) AS i, round(v, 6) AS coefficient FROM coef",
    "hash_bits": f"WITH {_HASH} SELECT vec_id, CAST(i AS INTEGER) AS i FROM h, range(64) i(i) WHERE i > 0 AND (hash >> (63 - greatest(i, 1))) & 1 = 1",
    "hash_bands": f"WITH {_HASH} SELECT vec_id, " + ", ".join(f"(hash >> {16 * k}) & 65535 AS band{k}" for k in range(4)) + " FROM h",
    "hash_from_hex": f"WITH {_HASH} SELECT vec_id, hash, hash >> 36 AS high, CAST(NULL AS BIGINT) AS none FROM h",
    "hamming_pairs_t18": f"WITH {_PAIRS} SELECT first, second, distance FROM pairs",
    "banded_pairs_t8": f"""WITH {_HASH}, m AS (SELECT vec_id, hash & 71777214294589695 AS hash FROM h)
SELECT a.vec_id AS first, b.vec_id AS second, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance
FROM m a JOIN m b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.hash, b.hash)) <= 8""",
    "pair_counters_t18": f"WITH {_PAIRS} SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM h) AS total_pairs, count(*) AS candidate_pairs FROM pairs",
    "hamming_histogram": f"WITH {_PAIRS} SELECT distance, count(*) AS pairs FROM pairs GROUP BY distance",
    "similarity_groups_t18": f"WITH RECURSIVE {_GROUPS} SELECT vec_id, group_id FROM grp",
    "group_sizes_t18": f"WITH RECURSIVE {_GROUPS} SELECT group_id, count(*) AS size FROM grp GROUP BY group_id",
    "group_count_t18": f"WITH RECURSIVE {_GROUPS} SELECT count(DISTINCT group_id) AS groups FROM grp",
    "group_conflicts_t18": f"WITH RECURSIVE {_GROUPS} SELECT group_id, first, second, distance, 18 AS threshold FROM far WHERE distance > 18",
    "group_diameter_t18": f"WITH RECURSIVE {_GROUPS} SELECT g.group_id, coalesce(max(distance), 0) AS diameter FROM (SELECT DISTINCT group_id FROM grp) g LEFT JOIN far USING (group_id) GROUP BY g.group_id",
    "conflicted_groups_t18": f"WITH RECURSIVE {_GROUPS} SELECT count(DISTINCT group_id) AS conflicted_groups FROM far WHERE distance > 18",
    "same_group_t18": f"WITH RECURSIVE {_GROUPS} SELECT e.vec_id AS first, e.vec_id + 1 AS second, coalesce(a.group_id = b.group_id, false) AS same_group FROM embeddings e LEFT JOIN grp a ON a.vec_id = e.vec_id LEFT JOIN grp b ON b.vec_id = e.vec_id + 1",
    "extension_filter": f"WITH {_SCORES} SELECT shot_id, path, ext AS extension FROM x WHERE {_ACCEPTED}",
    "capture_time_parse": f"WITH {_TIME} SELECT shot_id, capture_time FROM t",
    "pseudo_epoch": f"WITH {_TIME} SELECT shot_id, {_epoch('capture_time')} AS epoch FROM t",
    "capture_gap": f"WITH {_TIME}, g AS (SELECT burst_id, min(capture_time) AS first, max(capture_time) AS last FROM t WHERE capture_time IS NOT NULL GROUP BY burst_id) SELECT burst_id, first, last, {_epoch('last')} - {_epoch('first')} AS gap FROM g",
    "oriented_aspect": f"WITH {_SCORES} SELECT shot_id, w, h, round(aspect, 6) AS aspect FROM x",
    "crop_factor": f"WITH {_SCORES} SELECT shot_id, coalesce(round(CASE WHEN focal_mm > 0 AND width > 0 AND height > 0 THEN 43.266::DOUBLE * focal_mm / sqrt(width::DOUBLE * height) END, 10), 0.0) AS crop_factor FROM x",
    "exposure_rational": f"WITH {_SCORES} SELECT shot_id, round(e::FLOAT::DOUBLE, 7) AS exposure_s FROM x",
    "exposure_alias": f"WITH {_SCORES} SELECT shot_id, round(e, 7) AS exposure FROM x",
    "saturated_width": f"WITH {_SCORES} SELECT shot_id, least(width * 12, 65535) AS width FROM x",
    "clean_text": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN trim(o_orderpriority) END AS text FROM orders",
    "tag_lookup": """WITH l AS (SELECT *, l_returnflag = 'R' AS exif FROM lineitem)
SELECT l_orderkey, min(l_partkey) FILTER (NOT exif AND l_linenumber = 1) AS first,
  coalesce(min(l_partkey) FILTER (exif AND l_linenumber = 3), min(l_partkey) FILTER (NOT exif AND l_linenumber = 3), min(l_partkey) FILTER (exif AND l_linenumber = 2), min(l_partkey) FILTER (NOT exif AND l_linenumber = 2)) AS of_list,
  bool_or(exif AND l_linenumber = 1) AS has_first, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber) FILTER (NOT exif), '') AS tags FROM l GROUP BY l_orderkey""",
    "component_by_name": f"WITH {_SCORES} SELECT shot_id, round(iso_balance, 4) AS iso_balance, round(crop, 4) AS crop, CAST(NULL AS DOUBLE) AS none FROM x",
    "score_by_other_settings": f"""WITH {_SCORES}, y AS (SELECT *, CASE WHEN aspect > 0 THEN {_CLAMP("100 * exp(-abs(ln(aspect) - ln(1.25)) / 0.35)")} END AS c FROM x)
SELECT shot_id, round(CASE WHEN exposure IS NULL AND c IS NULL THEN 0 ELSE (coalesce(exposure * 0.5, 0) + coalesce(c * 1.5, 0)) / ((exposure IS NOT NULL)::INT * 0.5::DOUBLE + (c IS NOT NULL)::INT * 1.5::DOUBLE) END, 4) AS total, 2.0::DOUBLE AS weight_sum FROM y""",
    "score_components": f"WITH {_SCORES} SELECT shot_id, " + ", ".join(f"round({n}, 4) AS {n}" for n in ("sharpness", "exposure", "crop", "composition", "iso_balance")) + " FROM x",
    "score_total": f"WITH {_SCORES} SELECT shot_id, total, n AS n_components FROM x",
    "strongest_component": f"""WITH {_SCORES}, u AS (
  SELECT shot_id, round(sharpness, 6) AS v, 0 AS i, 'keskinlik' AS name FROM x UNION ALL SELECT shot_id, round(exposure, 6), 1, 'pozlama' FROM x
  UNION ALL SELECT shot_id, round(crop, 6), 2, 'kirpma' FROM x UNION ALL SELECT shot_id, round(composition, 6), 3, 'kompozisyon' FROM x
  UNION ALL SELECT shot_id, round(iso_balance, 6), 4, 'iso_dengesi' FROM x
) SELECT shot_id, arg_max(name, (v, i)) FILTER (v IS NOT NULL) AS strongest FROM u GROUP BY shot_id""",
    "recommendation_per_group": f"{_BEST} SELECT burst_id, path, total FROM r WHERE place = 1",
    "scan_statistics": f"WITH RECURSIVE {_FRAMES} {_STATS}",
    "read_ratio": f"WITH RECURSIVE {_FRAMES}, st AS ({_STATS}) SELECT round(bytes_read::DOUBLE / bytes_total, 9) AS read_ratio FROM st",
    "report_nested": f"{_REPORT} SELECT * FROM rep",
    "report_largest": f"{_REPORT} SELECT DISTINCT group_id, n_members, diameter FROM rep ORDER BY n_members DESC, group_id LIMIT 5",
    "export_plan": f"""{_BEST}, b AS (SELECT burst_id AS group_id, path AS source, concat('IMG_', burst_id % 97) AS stem FROM r WHERE place = 1),
nr AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY group_id) AS k FROM b)
SELECT group_id, source, concat(stem, CASE WHEN k > 1 THEN concat('-', k) ELSE '' END, '.CR2') AS target FROM nr""",
    "tiff_decode": f"SELECT * FROM (VALUES {_TIFF}) t(path, make, model, capture_time, exposure_s, f_number, iso, focal_mm, orientation, width, height, aspect, crop_factor)",
    "preview_locate": """SELECT * FROM (VALUES ('big_endian.dng', true, 'JPEGInterchangeFormat'), ('broken_preview.cr2', true, 'JPEGInterchangeFormat'), ('canon.cr2', true, 'JPEGInterchangeFormat'), ('color_420.cr2', true, 'JPEGInterchangeFormat'), ('color_422.nef', true, 'JPEGInterchangeFormat'),
  ('circle.cr2', false, NULL), ('flat.cr2', true, 'JPEGInterchangeFormat'), ('nikon.nef', false, NULL), ('sony.arw', true, 'JPEGInterchangeFormat'),
  ('strip.tif', true, 'StripOffsets'), ('unknown_type.cr2', false, NULL), ('zero_denominator.cr2', true, 'JPEGInterchangeFormat')) t(path, has_preview, preview_source)""",
    "jpeg_luma_hash": f"""SELECT * FROM (VALUES ('big_endian.dng', '{_CHECKER}'), ('canon.cr2', '{_CHECKER}'), ('color_420.cr2', '{_WIDE_CHECKER}'), ('color_422.nef', '{_HORIZONTAL}'), ('flat.cr2', '{_FLAT}'), ('sony.arw', '{_VERTICAL}'),
  ('strip.tif', '{_HORIZONTAL}'), ('zero_denominator.cr2', '{_CHECKER}')) t(path, hash_hex)""",
    "frames_without_hashing": f"SELECT path, false AS has_preview, CAST(NULL AS BIGINT) AS hash FROM (VALUES {_TIFF}) t(path, make, model, capture_time, exposure_s, f_number, iso, focal_mm, orientation, width, height, aspect, crop_factor)",
    "error_labels": """SELECT * FROM (VALUES ('big_tiff.tif', 'bigtiff'), ('far_directory.cr2', 'ifd-gecersiz'), ('long_value.cr2', 'ifd-gecersiz'), ('many_entries.cr2', 'ifd-gecersiz'),
  ('not_tiff.cr2', 'tiff-bazli-degil'), ('short.cr2', 'tiff-bazli-degil')) t(path, error)""",
}
