"""Column functions of the score: five components from metadata, their weighted mean, the strongest one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import Settings

# Names and remarks of the components in reports.
NAMES = {"sharpness": "keskinlik", "exposure": "pozlama", "crop": "kirpma", "composition": "kompozisyon", "iso_balance": "iso_dengesi"}
REMARKS = {"sharpness": "hareket riski", "exposure": "ışık", "crop": "kadraja alınmışlık", "composition": "kadraj", "iso_balance": "gürültü dengesi"}
MISSING = {
    "sharpness": ("poz süresi veya odak uzaklığı yok", "poz süresi veya odak geçersiz"),
    "exposure": ("ISO yok", "ISO geçersiz"),
    "crop": ("odak uzaklığı yok", "odak uzaklığı geçersiz"),
    "composition": ("boyut veya yön bilgisi yok", "en-boy oranı geçersiz"),
    "iso_balance": ("ISO yok", "ISO geçersiz"),
}


def percent(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))


def _double(c: Column) -> Column:
    return c.cast("double")


def sharpness(exposure: Column, focal: Column) -> Column:
    """Short exposures are sharp, long focal lengths ask for shorter ones."""
    e, f = _double(exposure), _double(focal)
    stops = F.log2(1 / e) + 1.5 * F.greatest(F.log2(f / 50), F.lit(0.0)) - 8
    return F.when((e > 0) & (f > 0), percent(stops * 100 / 6))


def exposure(iso: Column) -> Column:
    return F.when(iso > 0, percent((12 - F.log2(_double(iso))) * 100 / 6))


def crop(focal: Column) -> Column:
    f = _double(focal)
    return F.when(f > 0, percent(F.log2(f / 24) * 100 / 3))


def composition(aspect: Column, settings: Settings) -> Column:
    off = F.abs(F.ln(aspect) - math.log(settings.target_aspect)) / settings.composition_tolerance
    return F.when(aspect > 0, percent(100 * F.exp(-off)))


def iso_balance(iso: Column) -> Column:
    return F.when(iso > 0, percent((16 - F.log2(_double(iso))) * 100 / 8))


def scores(exposure_s: Column, focal_mm: Column, iso: Column, aspect: Column, settings: Settings) -> dict[str, Column]:
    return {"sharpness": sharpness(exposure_s, focal_mm), "exposure": exposure(iso), "crop": crop(focal_mm), "composition": composition(aspect, settings), "iso_balance": iso_balance(iso)}


def total(own: dict[str, Column], settings: Settings) -> Column:
    """Mean of the components that are there, by weight, added in their order; 0 without any weight."""
    zero, weights = F.lit(0.0), settings.weights()
    points = weight = zero
    for name, score in own.items():
        points = points + F.coalesce(score * weights[name], zero)
        weight = weight + F.when(score.isNotNull(), weights[name]).otherwise(zero)
    return F.when(weight > 0, points / weight).otherwise(zero)


def taking_part(own: dict[str, Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in own.values()), F.lit(0))


def strongest(own: dict[str, Column]) -> Column:
    """Name of the highest component, of equal ones the last; null without any."""
    pairs = F.array(*(F.when(c.isNotNull(), F.struct(c.alias("score"), F.lit(i).alias("i"), F.lit(NAMES[name]).alias("name"))) for i, (name, c) in enumerate(own.items())))
    return F.array_max(F.filter(pairs, lambda p: p.isNotNull()))["name"]


def rationales(exposure_s: Column, focal_mm: Column, iso: Column, aspect: Column, orientation: Column, bias: Column) -> dict[str, Column]:
    number = lambda form, c: F.format_string(form, _double(c))
    said = {
        "sharpness": (exposure_s.isNotNull() & focal_mm.isNotNull(), (exposure_s > 0) & (focal_mm > 0), [F.lit("1/"), number("%.0f", 1 / _double(exposure_s)), F.lit(" s, "), number("%.0f", focal_mm), F.lit(" mm")]),
        "exposure": (iso.isNotNull(), iso > 0, [F.format_string("ISO %d", iso), F.when(bias != 0, F.concat(F.lit(" (poz telafisi "), number("%+.1f", bias), F.lit(" EV)"))).otherwise("")]),
        "crop": (focal_mm.isNotNull(), focal_mm > 0, [number("%.0f", focal_mm), F.lit(" mm")]),
        "composition": (aspect.isNotNull(), aspect > 0, [F.lit("en-boy "), number("%.2f", aspect), F.when(orientation.between(5, 8), F.format_string(" (yön %d: döndürülmüş)", orientation)).otherwise("")]),
        "iso_balance": (iso.isNotNull(), iso > 0, [F.format_string("ISO %d", iso)]),
    }
    return {k: F.when(~there, MISSING[k][0]).when(~valid, MISSING[k][1]).otherwise(F.concat(*text, F.lit(f" -> {REMARKS[k]}"))) for k, (there, valid, text) in said.items()}


def score_struct(exposure_s: Column, focal_mm: Column, iso: Column, aspect: Column, orientation: Column, bias: Column, settings: Settings) -> Column:
    """struct<components, total, n_components>"""
    own = scores(exposure_s, focal_mm, iso, aspect, settings)
    why, weights = rationales(exposure_s, focal_mm, iso, aspect, orientation, bias), settings.weights()
    parts = [F.struct(F.lit(NAMES[k]).alias("name"), c.alias("score"), F.lit(weights[k]).alias("weight"), why[k].alias("rationale")) for k, c in own.items()]
    return F.struct(F.array(*parts).alias("components"), total(own, settings).alias("total"), taking_part(own).alias("n_components"))


def component(score: Column, name: str) -> Column:
    """A component of a score struct by its name, null without one."""
    return F.try_element_at(F.filter(score["components"], lambda c: c["name"] == name), F.lit(1))
