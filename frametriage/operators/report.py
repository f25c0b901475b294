"""Statistics of a scan, groups with members and recommendation, and the nested report."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors
from ..functions.phash import hash_from_hex, hash_hex
from ..functions.photo import ratio
from . import similarity

VERSION = "0.1.0"
SCHEMA_VERSION = 1


def statistics(frames: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row of counters; bytes are those of frames only."""
    rows = frames.select(F.lit(True).alias("frame"), "has_preview", F.col("hash").isNotNull().alias("hashed"), "bytes_read", "file_size")
    rows = rows.unionByName(skipped.select(F.lit(False).alias("frame")), allowMissingColumns=True)
    count, seen = F.count_if, F.col("frame") & F.col("has_preview")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count("*").alias("found"),
        count("frame").alias("meta_read"),
        count(seen).alias("preview_found"),
        count(F.col("frame") & ~F.col("has_preview")).alias("preview_missing"),
        count(seen & ~F.col("hashed")).alias("preview_broken"),
        count(F.col("frame") & F.col("hashed")).alias("hashed"),
        count(~F.col("frame")).alias("skipped"),
        total("bytes_read").alias("bytes_read"),
        total("file_size").alias("bytes_total"),
    )


def read_ratio(stats: DataFrame) -> DataFrame:
    return stats.select(ratio(F.col("bytes_read"), F.col("bytes_total")).alias("read_ratio"))


def recommend(members: DataFrame, group: str = "group_id") -> DataFrame:
    """The member of each group with the highest total, of equal ones the first path."""
    best = F.min_by(F.struct("path", "file_name", "score"), F.struct(-F.col("score.total"), "path"))
    return members.groupBy(group).agg(best.alias("best")).select(group, "best.*")


def rationale(file_name: Column, score: Column) -> Column:
    parts = F.transform(F.filter(score["components"], lambda c: c["score"].isNotNull()), lambda c: F.concat(c["name"], F.lit(" "), F.format_string("%.0f", c["score"])))
    return F.concat(file_name, F.lit(": toplam "), F.format_string("%.1f", score["total"]), F.lit(" puan ("), F.array_join(parts, ", "), F.lit(")"))


def _placed(frames: DataFrame) -> DataFrame:
    """Adds item, the frame's place in order of path, and alone, its place among those without hash. Frames of equal paths have a place each."""
    similarity.use_checkpoint_dir(frames.sparkSession)
    spread = frames.repartitionByRange("path", "hash").withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = spread.groupBy("_part").agg(F.count("*").alias("n"), F.count_if(F.col("hash").isNull()).alias("k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "k")))
    so_far = Window.partitionBy("_part").orderBy("path", "hash").rowsBetween(Window.unboundedPreceding, 0)
    own = spread.withColumn("item", F.count("*").over(so_far)).withColumn("alone", F.count_if(F.col("hash").isNull()).over(so_far))
    places = own.join(F.broadcast(shifts), "_part")
    return places.withColumn("item", F.col("item") + F.col("_n") - 1).withColumn("alone", F.when(F.col("hash").isNull(), F.col("alone") + F.col("_k") - 1)).drop("_part", "_n", "_k")


def _groups_of(placed: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """item, hash, group_id of the frames with a hash; item, group_id of the others, each a group of one, numbered on in order of path."""
    membership = similarity.groups(placed.where("hash is not null").select("item", "hash"), t).checkpoint()
    numbered = membership.agg(F.coalesce(F.max("group_id") + 1, F.lit(0)).alias("n")).first()["n"]
    return membership, placed.where("hash is null").select("item", (F.col("alone") + numbered).alias("group_id"))


def _facts(groups: DataFrame, t: int) -> DataFrame:
    return groups.withColumn("conflicted", F.col("diameter") > min(t, 64))


def grouped(frames: DataFrame, t: int) -> tuple[DataFrame, DataFrame]:
    """Frames with group_id, and the groups' diameter and conflicted.

    Frames with a hash are grouped; the others follow as groups of one, numbered on in order of path.
    """
    placed = _placed(frames)
    membership, alone = _groups_of(placed, t)
    of = membership.select("item", "group_id").unionByName(alone)
    facts = similarity.diameters(membership).unionByName(alone.select("group_id", F.lit(0).alias("diameter")))
    return placed.drop("alone").join(of, "item"), _facts(facts, t)


def group_facts(frames: DataFrame, t: int) -> DataFrame:
    """group_id, n_members, diameter, conflicted of the report's groups, from paths and hashes alone; no group's members are gathered."""
    membership, alone = _groups_of(_placed(frames.select("path", "hash")), t)
    sizes = membership.groupBy("group_id").agg(F.count("*").cast("int").alias("n_members"))
    hashed = sizes.join(similarity.diameters(membership), "group_id")
    return _facts(hashed.unionByName(alone.select("group_id", F.lit(1).alias("n_members"), F.lit(0).alias("diameter"))), t)


def report_groups(frames: DataFrame, t: int) -> DataFrame:
    """group_id, recommended, rationale, conflicted, diameter, n_members, members (highest total first, then by path)."""
    members, facts = grouped(frames, t)
    member = F.struct((-F.col("score.total")).alias("key"), "path", "file_name", F.when(F.col("hash").isNotNull(), hash_hex(F.col("hash"))).alias("hash"), "score")
    sorted_ = F.array_sort(F.collect_list(member))
    nested = members.groupBy("group_id").agg(sorted_.alias("m"))
    shown = F.transform("m", lambda x: F.struct(x["path"].alias("path"), x["file_name"].alias("file_name"), x["hash"].alias("hash"), x["score"].alias("score"), x["score"]["total"].alias("total")))
    best = F.col("m")[0]
    out = nested.join(facts, "group_id")
    return out.select("group_id", best["path"].alias("recommended"), rationale(best["file_name"], best["score"]).alias("rationale"), "conflicted", "diameter", F.size("m").alias("n_members"), shown.alias("members"))


#: Keys of the report file.
GROUP_KEYS = {"group_id": "kimlik", "recommended": "oneri", "rationale": "gerekce", "conflicted": "cakismali", "diameter": "en_uzak_mesafe", "members": "uyeler"}
MEMBER_KEYS = {"path": "yol", "file_name": "dosya_adi", "hash": "hash", "score": "puan", "total": "toplam_puan"}
SCORE_KEYS = {"components": "bilesenler", "total": "toplam", "n_components": "katilan_bilesen"}
COMPONENT_KEYS = {"name": "ad", "score": "puan", "weight": "agirlik", "rationale": "gerekce"}
STAT_KEYS = {
    "found": "bulunan_dosya",
    "meta_read": "meta_okunan",
    "preview_found": "onizleme_bulunan",
    "preview_missing": "onizleme_yok",
    "preview_broken": "onizleme_bozuk",
    "hashed": "hash_uretilen",
    "skipped": "atlanan",
    "bytes_read": "toplam_okunan_bayt",
    "bytes_total": "toplam_dosya_boyutu",
}
SKIPPED_KEYS = {"path": "yol", "error": "hata", "detail": "ayrinti"}
REPORT_KEYS = ["surum", "sema", "kok", "esik", "istatistik", "gruplar", "atlanan"]


def _renamed(c: Column, keys: dict[str, str], **inner) -> list[Column]:
    return [inner.get(k, lambda x: x)(c[k]).alias(v) for k, v in keys.items()]


def _score(c: Column) -> Column:
    parts = lambda x: F.transform(x, lambda y: F.struct(*_renamed(y, COMPONENT_KEYS)))
    return F.struct(*_renamed(c, SCORE_KEYS, components=parts))


def report_rows(groups: DataFrame) -> DataFrame:
    """The groups under the keys of the report file, largest first."""
    members = lambda c: F.transform(c, lambda m: F.struct(*_renamed(m, MEMBER_KEYS, score=_score)))
    columns = [(members if k == "members" else lambda x: x)(F.col(k)).alias(v) for k, v in GROUP_KEYS.items()]
    return groups.orderBy(F.desc("n_members"), "group_id").select(*columns)


def write_report(path: str | None, root: str, t: int, frames: DataFrame, skipped: DataFrame) -> str:
    """The report as one JSON document, two spaces deep. The groups come to the driver one partition at a time."""
    stats = statistics(frames, skipped).first().asDict()
    text = {
        "surum": VERSION,
        "sema": SCHEMA_VERSION,
        "kok": root,
        "esik": t,
        "istatistik": {v: stats[k] for k, v in STAT_KEYS.items()},
        "gruplar": [json.loads(x) for x in report_rows(report_groups(frames, t)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator() for x in x],
        "atlanan": [{v: row[k] for k, v in SKIPPED_KEYS.items()} for row in skipped.orderBy("path").toLocalIterator()],
    }
    out = json.dumps(text, indent=2, ensure_ascii=False)
    if path is not None:
        try:
            Path(path).write_text(out)
        except OSError as e:
            raise errors.TriageError(errors.IO, path, str(e)) from e
    return out


def read_report(path: str) -> dict:
    """A report file; all keys must be there."""
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise errors.TriageError(errors.IO, path, str(e)) from e
    try:
        report = json.loads(text)
    except ValueError as e:
        raise errors.TriageError(errors.PARAMETER, path, str(e)) from e
    lacking = [k for k in REPORT_KEYS if not isinstance(report, dict) or k not in report]
    lacking += [k for g in (report.get("gruplar", []) if not lacking else []) for k in GROUP_KEYS.values() if k not in g]
    if lacking:
        raise errors.TriageError(errors.PARAMETER, path, f"without {', '.join(sorted(set(lacking)))}")
    return report


#: Spark's schema of the report's groups, under the same keys.
GROUP_SCHEMA = (
    "kimlik bigint, oneri string, gerekce string, cakismali boolean, en_uzak_mesafe int, uyeler array<struct<yol string, dosya_adi string, hash string, "
    "puan struct<bilesenler array<struct<ad string, puan double, agirlik double, gerekce string>>, toplam double, katilan_bilesen int>, toplam_puan double>>"
)


def _members(groups: DataFrame) -> DataFrame:
    rows = groups.select(F.col("kimlik").alias("group_id"), F.explode("uyeler").alias("m"))
    return rows.select("group_id", F.col("m.yol").alias("path"), hash_from_hex(F.col("m.hash")).alias("hash"), F.col("m.toplam_puan").alias("total"))


def members_of_report(spark, path: str) -> DataFrame:
    """group_id, path, hash, total of all members of a report file, read by Spark."""
    file = spark.read.schema(f"gruplar array<struct<{GROUP_SCHEMA}>>").option("multiLine", True).json(path)
    return _members(file.select(F.inline("gruplar")))


def save_report(path: str, root: str, t: int, frames: DataFrame, skipped: DataFrame) -> None:
    """The report as a folder of JSON lines, for collections too large for one document: gruplar, atlanan and one line of baslik.

    All parts are written by the executors, in the order of the document; nothing comes to the driver.
    """
    kept = {"ignoreNullFields": "false"}
    report_rows(report_groups(frames, t)).write.options(**kept).json(f"{path}/gruplar")
    skipped.orderBy("path").select(*(F.col(k).alias(v) for k, v in SKIPPED_KEYS.items())).write.options(**kept).json(f"{path}/atlanan")
    counts = F.struct(*(F.col(k).alias(v) for k, v in STAT_KEYS.items())).alias("istatistik")
    statistics(frames, skipped).select(F.lit(VERSION).alias("surum"), F.lit(SCHEMA_VERSION).alias("sema"), F.lit(root).alias("kok"), F.lit(t).alias("esik"), counts).write.options(**kept).json(f"{path}/baslik")


def saved_members(spark, path: str) -> DataFrame:
    """group_id, path, hash, total of all members of a saved report."""
    return _members(spark.read.schema(GROUP_SCHEMA).json(f"{path}/gruplar"))
