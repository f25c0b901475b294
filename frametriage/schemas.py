"""Schemas of the main tables, as DDL."""

ENTRY = "struct<ifd string, tag int, type int, count bigint, value_offset bigint, value binary>"
#: What the decoder gives for each file; error is null for a frame.
DECODED = (
    "path string, file_name string, file_size bigint, bytes_read bigint, error string, detail string, "
    "make string, model string, software string, capture_raw string, exposure_s float, f_number float, focal_mm float, exposure_bias float, "
    "iso int, orientation int, compression int, samples int, metering int, program int, flash int, white_balance int, photometric int, "
    "width int, height int, strip_bytes bigint, preview_offset bigint, preview_bytes bigint, preview_source string, hash bigint"
)
META = (
    "struct<make string, model string, capture_time string, exposure_s float, f_number float, iso int, focal_mm float, "
    "orientation int, width int, height int, aspect double, crop_factor double>"
)
COMPONENT = "struct<name string, score double, weight double, rationale string>"
SCORE = f"struct<components array<{COMPONENT}>, total double, n_components int>"
FRAMES = f"path string, file_name string, file_size bigint, bytes_read bigint, hash bigint, has_preview boolean, preview_bytes bigint, meta {META}, score {SCORE}"
SKIPPED = "path string, error string, detail string"
STATS = "found bigint, meta_read bigint, preview_found bigint, preview_missing bigint, preview_broken bigint, hashed bigint, skipped bigint, bytes_read bigint, bytes_total bigint"
