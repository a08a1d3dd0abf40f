"""Files and their text.

Spark's own file sources drop names that begin with ``_`` or ``.`` and what is
below such folders, so listing is our own. Readers are injected by kind, so
that one which needs a library or a model can be put in; a reader's failure
is a text, never a failed task.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text, validate
from ..session import materialise, spread

MOST_PAGES = 2


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, suffix, kind) of every regular file below ``root`` whose own name is not hidden.

    ``root`` is a folder that every executor sees. Tasks list the folders of one level after the other, so no task walks a whole
    branch and the driver lists nothing; links to folders are not followed, and folders that cannot be read are passed over.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                try:
                    with os.scandir(folder) as entries:
                        rows = [(e.path, e.is_dir(follow_symlinks=False)) for e in entries if e.is_dir(follow_symlinks=False) or e.is_file()]
                except OSError:
                    pass
                yield pd.DataFrame(rows, columns=["path", "folder"]).astype({"path": "object", "folder": "bool"})

    level, found = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None
    while found is None or not level.isEmpty():
        listed = materialise(spread(level, "path").mapInPandas(look, "path string, folder boolean"), "listing")
        files, level = listed.where("not folder").select("path"), listed.where("folder").select("path")
        found = files if found is None else found.unionByName(files)
    c = F.col("path")
    return found.select(c, paths.name(c).alias("name"), paths.suffix(c).alias("suffix"), paths.kind(c).alias("kind")).where(paths.visible(c))


def read_text_file(path: str) -> str:
    return Path(path).read_text(encoding="utf-8", errors="ignore")


def read_pdf(path: str, most: int = MOST_PAGES) -> str:
    """The first pages; needs PyMuPDF, without which the text is empty."""
    try:
        import fitz
    except ImportError:
        return ""
    with fitz.open(path) as doc:
        return "\n".join(doc[i].get_text() for i in range(min(len(doc), most))).strip()


def read_docx(path: str) -> str:
    """The paragraphs that hold text; tables are not read. A docx is a zip of XML, so no library is needed."""
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(path).read("word/document.xml")).find(f"{w}body")
    lines = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in (body if body is not None else []) if p.tag == f"{w}p"]
    return "\n".join(x for x in lines if x.strip())


def read_image(path: str) -> str:
    """The scan's text; needs pytesseract, without which it is empty."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError:
        return ""
    return pytesseract.image_to_string(Image.open(path)).strip()


def no_caption(path: str) -> str:
    """The stub that stands for a vision model."""
    return ""


READERS: dict[str, Callable[[str], str]] = {"pdf": read_pdf, "docx": read_docx, "image": read_image, "text": read_text_file}
#: Kinds whose reader gives the empty text where it fails; of the others the failure is the text.
SILENT = ("pdf", "docx", "image")


def _reader(read: Callable[[str], str], on_error: Callable[[Exception], str]) -> Callable:
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(path: str) -> str:
            try:
                return read(path)
            except Exception as e:  # noqa: BLE001 - a file's error stays with the file
                return on_error(e)

        return values.map(one)

    return run


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """The bytes of a plain text file as text; bytes that are none are left out."""
    return content.map(lambda b: b.decode("utf-8", errors="ignore"), na_action="ignore")


def with_content(files: DataFrame, readers: dict[str, Callable[[str], str]] | None = None, caption: Callable[[str], str] = no_caption, attempts: int = 2, wait: float = 0.0) -> DataFrame:
    """Adds content. Each kind is a branch of its own, so a reader sees its own files only. A caption that is refused for too many
    calls is asked for ``attempts`` times, ``wait`` seconds apart."""
    caption = validate.retried(caption, attempts, wait)
    readers = READERS | (readers or {})
    parts = []
    for kind, read in readers.items():
        own = files.where(F.col("kind") == kind)
        got = _reader(read, (lambda e: "") if kind in SILENT else (lambda e: f"Eroare extracție: {e}"))(F.col("path"))
        if kind == "image":
            seen = _reader(caption, lambda e: f"Eroare Vision AI: {e}")(F.col("path"))
            got = text.image_text(seen, got)
        parts.append(own.withColumn("content", got))
    out = files.where(~F.coalesce(F.col("kind").isin(*readers), F.lit(False))).withColumn("content", text.unknown_type_text(F.lower("suffix")))
    for part in parts:
        out = out.unionByName(part)
    return out.withColumn("content", text.content_or_default(F.col("content")))
