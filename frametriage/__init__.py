"""PySpark-native triage of photo bursts: list, decode, hash, group, score, recommend, export."""

from .errors import TriageError
from .operators.report import VERSION as __version__
from .settings import Settings

__all__ = ["Settings", "TriageError", "__version__"]
