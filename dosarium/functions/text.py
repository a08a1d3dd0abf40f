"""Scalar text functions as column expressions, with the SQL text of each for the oracle.

Null in, null out, unless a docstring says otherwise; texts of any length are
handled whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text, as ranges, and those a file name must not hold.
SPACE_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SPACES = "".join(chr(c) for first, last in SPACE_RANGES for c in range(first, last + 1))
SPACE_RE2 = "[" + "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in SPACE_RANGES) + "]"
UNSAFE = r'[<>:"/\\|?*]'
# Texts that stand where content is missing, and how a log line is read, first match first.
EMPTY_CONTENT = "Conținut gol sau necitibil"
MARKER, OCR_MARKER = "Image Vision Analysis:", "Extracted OCR Text:"
SEVERITIES = (("success", ("succes", "complet")), ("error", ("eroare", "lipsă")), ("warning", ("carantină", "quarantine", "skip")), ("process", ("procesare", "vision")))
TEMPLATE_TOKENS = {"[An]": "year", "[Luna]": "month", "[TipDocument]": "document_type", "[Emitent]": "issuer", "[SubiectAI]": "subject"}
SUMMARY_CUT, REASON_CUT, MOST_SUMMARY = 200, 100, 500


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g')"


def sanitise(c: Column) -> Column:
    """Characters that file systems refuse become underlines."""
    return F.regexp_replace(c, UNSAFE, "_")


def technical_summary(c: Column) -> Column:
    """The first 200 code points."""
    return F.substring(c, 1, SUMMARY_CUT)


def reason_text(status: Column, summary: Column) -> Column:
    """Why a file is under review; the dots stand even after a short summary."""
    return F.concat(F.lit("Decizie AI ("), status, F.lit(") bazată pe: "), F.substring(summary, 1, REASON_CUT), F.lit("..."))


def null_display(c: Column) -> Column:
    """A dash for null and for the empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))


def content_or_default(c: Column) -> Column:
    """The stand-in for null and for the empty text; white space is content."""
    return F.when(c.isNull() | (c == ""), F.lit(EMPTY_CONTENT)).otherwise(c)


def image_text(caption: Column, ocr: Column) -> Column:
    return F.concat(F.lit(MARKER + "\n"), caption, F.lit("\n\n" + OCR_MARKER + "\n"), ocr)


def unknown_type_text(suffix: Column) -> Column:
    return F.concat(F.lit("Fișier de tip necunoscut ("), suffix, F.lit("). Conținut text nedisponibil."))


def log_cleanup(c: Column) -> Column:
    """Stripped, with the two characters backslash and n as a line break; real line breaks stay."""
    return F.replace(strip(c), F.lit("\\n"), F.lit("<br>"))


def log_severity(c: Column) -> Column:
    """The first class one of whose words stands in the message; null for blank messages, which are not shown."""
    low = F.lower(c)
    out = F.when(strip(c) == "", F.lit(None).cast("string"))
    for name, words in SEVERITIES:
        held = low.contains(words[0])
        for w in words[1:]:
            held = held | low.contains(w)
        out = out.when(held, F.lit(name))
    return out.when(c.isNotNull(), F.lit("default"))


def progress(done: Column, total: Column) -> Column:
    """Whole percent, cut off, not rounded. A total of 0 gives null."""
    return (done.cast("double") / F.nullif(total, F.lit(0)).cast("double") * 100).cast("int")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Our own deterministic filling of the naming tokens; a null value leaves the empty text."""
    out = template
    for token, name in TEMPLATE_TOKENS.items():
        if name in values:
            out = F.replace(out, F.lit(token), F.coalesce(values[name], F.lit("")))
    return out


def strip_fences(c: Column) -> Column:
    """A model's answer without the code fence around it, as ``validate.unfence`` reads it; a fence without a line break stays, which no answer has."""
    bare = strip(c)
    return F.when(bare.startswith("```") & F.contains(bare, F.lit("\n")), F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n", ""), r"\n?```\s*$", "")).otherwise(bare)


def join_paragraphs(parts: Column) -> Column:
    """The paragraphs that hold text, a line each."""
    return F.array_join(F.filter(parts, lambda p: strip(p) != ""), "\n")


def first_pages(pages: Column, most: int) -> Column:
    """The text of the first pages, stripped."""
    return strip(F.array_join(F.slice(pages, 1, most), "\n"))


def flatten_payload(parts: Column) -> Column:
    """The texts of a list of answer parts (struct with a field text), joined by blanks."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), " ")


def prompt_of(template: str, **values: Column) -> Column:
    """``template`` with ``{name}`` replaced by columns; a null value leaves the empty text."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def descriptive_name(text: Column, original: Column, suffix: Column) -> Column:
    """A file name made of an image's caption.

    The caption stands between the marker and the next marker or the text of the
    scan. Without one, or where the caption reports an error, the original name
    stays. Blanks become underlines, everything but ASCII letters, digits,
    underline and hyphen goes, dots included; then the suffix is added unless
    the name ends in it.
    """
    part = F.substring_index(F.substring_index(text, MARKER, 2), MARKER, -1)
    caption = strip(F.substring_index(part, OCR_MARKER, 1))

    def with_caption(c: Column) -> Column:
        kept = F.regexp_replace(F.translate(c, " ", "_"), r"[^a-zA-Z0-9_-]", "")
        usable = text.contains(MARKER) & (c != "") & ~c.startswith("Eroare")
        return once(F.when(usable, kept), lambda k: F.when(F.coalesce(k, F.lit("")) == "", original).when(F.endswith(F.lower(k), F.lower(suffix)), k).otherwise(F.concat(k, suffix)))

    return F.when(text.isNotNull(), once(caption, with_caption)).otherwise(original)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` worked out a single time however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)
