"""Labels of what can go wrong with a file or a call, and the exception that carries one."""

from __future__ import annotations

# Labels that reports are read by.
IO = "io"
SCAN_PATH = "tarama-yolu"
NOT_TIFF = "tiff-bazli-degil"
BIG_TIFF = "bigtiff"
BAD_IFD = "ifd-gecersiz"
IFD_LIMIT = "ifd-sinir"
NO_PREVIEW = "onizleme-yok"
BROKEN_PREVIEW = "onizleme-bozuk"
BAD_SETTINGS = "ayar-gecersiz"
DESTINATION = "hedef-cakisti"
PARAMETER = "parametre"

#: One line about each label.
MEANING = {
    IO: "reading or writing failed",
    SCAN_PATH: "the path to scan is not a directory",
    NOT_TIFF: "no TIFF header",
    BIG_TIFF: "a TIFF version other than 42",
    BAD_IFD: "a directory or value is out of bounds",
    IFD_LIMIT: "too many directories",
    NO_PREVIEW: "no embedded preview",
    BROKEN_PREVIEW: "the preview cannot be decoded",
    BAD_SETTINGS: "the settings are not valid",
    DESTINATION: "the destination overlaps the source",
    PARAMETER: "a parameter is not valid",
}


class TriageError(Exception):
    """Carries a label, what it is about, and a detail."""

    def __init__(self, label: str, subject: str, detail: str = ""):
        self.label, self.subject, self.detail = label, subject, detail
        super().__init__(f"{MEANING[label]} ({subject})" + (f": {detail}" if detail else ""))
