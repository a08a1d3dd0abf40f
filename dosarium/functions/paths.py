"""Path functions as column expressions. Paths use ``/``; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes by the way their content is read, those with a preview, and the image types that are named by their own.
KINDS = {"pdf": (".pdf",), "image": (".png", ".jpg", ".jpeg", ".bmp", ".tiff"), "docx": (".docx",), "text": (".txt", ".csv", ".md")}
PREVIEWABLE = (".png", ".jpg", ".jpeg", ".bmp")
DEFAULT_FOLDER, QUARANTINE_FOLDER = "Organized", "Quarantine"
EVERYTHING = ("any", "all")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^((?s).*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """From the last dot of the name, if it is neither its first nor its last character."""
    return F.regexp_extract(name(path), r"^(?s).+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    own = name(path)
    return F.substring(own, F.lit(1), F.length(own) - F.length(suffix(path)))


def kind(path: Column) -> Column:
    """pdf, image, docx, text or unknown, by the suffix without regard to case."""
    low = F.lower(suffix(path))
    out = F.when(path.isNull(), F.lit(None).cast("string"))
    for k, suffixes in KINDS.items():
        out = out.when(low.isin(*suffixes), F.lit(k))
    return out.otherwise(F.lit("unknown"))


def previewable(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*PREVIEWABLE)


def mime(path: Column) -> Column:
    low = F.lower(suffix(path))
    return F.when(low == ".png", "image/png").when(low == ".bmp", "image/bmp").otherwise("image/jpeg")


def data_url(path: Column, content: Column) -> Column:
    """An image's bytes as a model takes them."""
    return F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))  # without line breaks


def join(left: Column, right: Column) -> Column:
    """An absolute right side replaces the left; ``.`` and the empty text add nothing."""
    return F.when(right.startswith("/"), right).when(right.isin(".", ""), left).otherwise(F.concat_ws("/", F.regexp_replace(left, "/+$", ""), right))


def append_suffix(c: Column, end: Column) -> Column:
    """The suffix is added unless the name ends in it, without regard to case."""
    return F.when(F.endswith(F.lower(c), F.lower(end)), c).otherwise(F.concat(c, end))


def escapes(folder: Column) -> Column:
    """Whether a folder leaves the destination: absolute, or with a step upwards."""
    return folder.startswith("/") | folder.rlike(r"(^|/)\.\.(/|$)")


def visible(path: Column) -> Column:
    """A file is hidden by a dot at the start of its own name only."""
    return ~name(path).startswith(".")


def folder_or_default(folder: Column, stripped: Column) -> Column:
    """``any``, ``all`` and nothing mean the default folder; anything else stays as typed."""
    return F.when(F.lower(stripped).isin(*EVERYTHING, ""), DEFAULT_FOLDER).otherwise(folder)
