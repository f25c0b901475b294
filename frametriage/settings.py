"""Weights and targets of the score."""

from __future__ import annotations

import dataclasses
import json
import math
from pathlib import Path

from . import errors

#: Keys of the settings file, in the order of the fields below.
KEYS = {
    "sharpness": "agirlik_keskinlik",
    "exposure": "agirlik_pozlama",
    "crop": "agirlik_kirpma",
    "composition": "agirlik_kompozisyon",
    "iso_balance": "agirlik_iso",
    "iso_enough": "iso_yeterli",
    "target_aspect": "hedef_en_boy",
    "composition_tolerance": "kompozisyon_tolere",
    "shortest_sharp_exposure": "keskin_min_poz",
}
WEIGHTS = ["sharpness", "exposure", "crop", "composition", "iso_balance"]


@dataclasses.dataclass(frozen=True)
class Settings:
    sharpness: float = 0.30
    exposure: float = 0.25
    crop: float = 0.10
    composition: float = 0.20
    iso_balance: float = 0.15
    #: Validated and carried along; no formula uses it.
    iso_enough: float = 1600.0
    target_aspect: float = 1.5
    composition_tolerance: float = 0.35
    #: Carried along; no formula uses it.
    shortest_sharp_exposure: float = 0.004

    def weights(self) -> dict[str, float]:
        return {w: getattr(self, w) for w in WEIGHTS}

    def weight_sum(self) -> float:
        return sum(self.weights().values())

    def problem(self) -> str | None:
        """The first thing that is wrong, if any is."""
        checks = {
            "weights must be finite and not negative": all(math.isfinite(w) and w >= 0 for w in self.weights().values()),
            "the weights' sum must be positive": self.weight_sum() > 0,
            "hedef_en_boy must be finite and positive": math.isfinite(self.target_aspect) and self.target_aspect > 0,
            "iso_yeterli must be positive": self.iso_enough > 0,
        }
        return next((what for what, holds in checks.items() if not holds), None)


def from_mapping(values: dict, subject: str = "settings") -> Settings:
    """Missing keys keep their defaults, unknown ones are passed over."""
    try:
        own = Settings(**{field: float(values[key]) for field, key in KEYS.items() if key in values})
    except (TypeError, ValueError) as e:
        raise errors.TriageError(errors.BAD_SETTINGS, subject, str(e)) from e
    if (problem := own.problem()) is not None:
        raise errors.TriageError(errors.BAD_SETTINGS, subject, problem)
    return own


def load(path: str | None) -> Settings:
    """Settings from a JSON file; the defaults without one."""
    if path is None:
        return Settings()
    try:
        values = json.loads(Path(path).read_text())
    except OSError as e:
        raise errors.TriageError(errors.IO, path, str(e)) from e
    except ValueError as e:
        raise errors.TriageError(errors.BAD_SETTINGS, path, str(e)) from e
    if not isinstance(values, dict):
        raise errors.TriageError(errors.BAD_SETTINGS, path, "not an object")
    return from_mapping(values, path)
