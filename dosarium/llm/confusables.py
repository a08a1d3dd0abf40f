"""One consistent form for text that looks alike.

``skeleton`` decomposes, replaces every character by the prototype of its
look-alike class and decomposes again; originals with equal skeletons form one
group. ``consistent`` is the form that a group is brought to: within a word,
every letter of another alphabet is replaced by the letter of the word's own
alphabet that has the same prototype, so text and form have one skeleton (but
for the lunate sigma, which in a Greek word is the compatible form of sigma).

The classes are those of the public Unicode look-alike data, which the driver
reads from the library that Spark itself ships; about 6,000 characters, sent to
the workers as one broadcast. The pairs below come first; other operators, which
only fold text, use them alone. Where the data cannot be read, ``lookalike_groups``
and ``changed_records`` fail: by the pairs alone most look-alikes would stay as they are.

Defined results: null stays null and is never changed; the empty text is
consistent; a word of several alphabets without look-alikes stays as it is and
counts as changed; texts of any length are handled whole; repeated rows give
repeated rows unless a key is asked for; columns of the input are not read
beyond those named, so clashing extra columns do no harm.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, spread

# Letters of other alphabets and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝүгвкмнт", "ABESIJKMHOPCTYXYQWaesijopcyxhdqwyrBKMHT"))
CYRILLIC_STRICT = dict(zip("АВЕЅІЈКМНОРСТХҮԚԜаеѕіјорсухһԁԛԝү", "ABESIJKMHOPCTXYQWaesijopcyxhdqwy"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινυρκςγϲϳϹ", "ABEZHIKMNOPTYXoaivupkcycjC"))
OTHER = dict(zip("ıɑɡℓǀӏƅ", "iagllIb"))
#: Letters whose compatible form is a letter of other looks.
LUNATE = "\u03f2\u03f9"
CEDILLA = dict(zip("şţŞŢ", "șțȘȚ"))
# Marks that are invisible though not of category Cf.
INVISIBLE = frozenset("͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠎")
# Signs read as the ordinary hyphen.
HYPHENS = frozenset("‐‑‒⁃−﹣－")
PROTOTYPES = {**CYRILLIC, **GREEK, **OTHER, **{h: "-" for h in HYPHENS}, "1": "l", "I": "l", "|": "l", "0": "O"}
PROTOTYPES = {k: PROTOTYPES.get(v, v) for k, v in PROTOTYPES.items()}  # a prototype is its own prototype
TO_LATIN = {**CYRILLIC_STRICT, **CYRILLIC, **GREEK}
TO_CYRILLIC = {v: k for k, v in reversed(CYRILLIC_STRICT.items())}
TO_GREEK = {v: k for k, v in reversed(GREEK.items()) if k not in LUNATE}


@lru_cache(maxsize=65536)
def invisible(ch: str) -> bool:
    return ch in INVISIBLE or unicodedata.category(ch) == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


@lru_cache(maxsize=65536)
def alphabet(ch: str) -> str:
    """The alphabet of a letter by its Unicode name; none for letters of all alphabets and for scripts that are written together with any."""
    if not ch.isalpha():
        return ""
    plain = unicodedata.normalize("NFKC", ch)
    if plain != ch and len(plain) == 1:
        return alphabet(plain)
    first = unicodedata.name(ch, "OTHER").split()[0]
    return "" if first in ("MODIFIER", "CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC") else first


def _ordinary(ch: str) -> bool:
    """A Latin letter of the blocks for ordinary writing, or one made of such a letter and marks."""
    return ch < "\u0180" or "\u1e00" <= ch <= "\u1eff" or unicodedata.normalize("NFD", ch) != ch


class Lookalikes:
    """Skeletons and consistent forms by a table of prototypes."""

    def __init__(self, table: dict[str, str]):
        # What the pairs above join, joins the whole classes of the table.
        joined = {table[c]: p for c, p in PROTOTYPES.items() if len(table.get(c, "")) == 1 and table[c] != p and table[c] not in PROTOTYPES}
        first = {**joined, **PROTOTYPES}
        self.prototypes = {c: "".join(first.get(x, x) for x in p) for c, p in table.items()} | first
        own: dict[str, dict[tuple[str, bool], str]] = {}
        for c in sorted(self.prototypes.keys() | set(self.prototypes.values())):
            loose = c in CYRILLIC and c not in CYRILLIC_STRICT  # these look alike in some typefaces only
            if len(c) == 1 and alphabet(c) and not loose and unicodedata.normalize("NFKC", c) == c:
                own.setdefault(alphabet(c), {}).setdefault((self.prototype(c), c.isupper()), c)
        for name, back in (("CYRILLIC", TO_CYRILLIC), ("GREEK", TO_GREEK)):
            own.setdefault(name, {}).update({(self.prototype(latin), c.isupper()): c for latin, c in back.items()})
        self.own = own
        #: Letters that look like a plain letter of their own alphabet, such as small capitals.
        self.rare = {c: p for c, p in self.prototypes.items() if len(p) == 1 and p.isascii() and p.isalpha() and p != c and alphabet(c) == "LATIN" and not _ordinary(c) and unicodedata.normalize("NFKC", c) == c}

    def prototype(self, ch: str) -> str:
        return self.prototypes.get(ch, ch)

    def skeleton(self, text: str | None) -> str | None:
        """Equal for texts that look equal."""
        if text is None:
            return None
        out = []
        for ch in unicodedata.normalize("NFKD", self._deferred(text)):
            if invisible(ch):
                continue
            if ch == "\u0327":  # the cedilla is read as the comma below
                ch = "\u0326"
            out.append(" " if ch.isspace() else self.prototypes.get(ch, ch))
        return unicodedata.normalize("NFD", "".join(out))

    def _deferred(self, text: str) -> str:
        """Letters whose compatible form looks otherwise (the lunate sigmas) go by their looks."""
        return "".join(PROTOTYPES[c] if c in LUNATE else c for c in text) if any(c in text for c in LUNATE) else text

    def letter(self, name: str, ch: str) -> str | None:
        """The letter of the alphabet ``name`` that looks like ``ch``."""
        if name == "LATIN":
            plain = TO_LATIN.get(ch) or self.prototypes.get(ch, "")
            if len(plain) != 1 or alphabet(plain) != "LATIN":
                return None
            return "I" if plain == "l" and ch.isupper() else plain
        plain = ch if ch in self.prototypes or ch in LUNATE else unicodedata.normalize("NFKC", ch)
        letters = self.own.get(name, {})
        found = letters.get((self.prototype(plain), plain.isupper()))
        return found if found or plain.isupper() or plain.islower() else letters.get((self.prototype(plain), True))

    def one_alphabet(self, word: str) -> str:
        """The word with the letters of other alphabets replaced by its own, where they look alike."""
        kinds = [alphabet(c) for c in word]
        names = set(kinds) - {""}
        if len(names) > 1:
            # The word's own alphabet can write most of its letters; of several, that of the letters which no other alphabet has.
            able = {name: sum(not k or k == name or self.letter(name, c) is not None for c, k in zip(word, kinds)) for name in names}
            sure = dict.fromkeys(names, 0)
            for c, k in zip(word, kinds):
                if k and all(self.letter(other, c) is None for other in names - {k}):
                    sure[k] += 1
            best = max(sorted(names), key=lambda k: (able[k], sure[k], kinds.count(k), k == "LATIN"))
            word = "".join(c if k in ("", best) else self.letter(best, c) or c for c, k in zip(word, kinds))
            names = {best}
        if names == {"LATIN"} and not word.isascii() and any(c in self.rare for c in word) and any(c.isascii() and c.isalpha() for c in word):
            word = "".join(self.rare.get(c, c) for c in word)
        return word

    def read(self, text: str | None) -> tuple[str | None, bool]:
        """(consistent form, whether a word has letters of several alphabets that nothing can replace)"""
        if text is None or text.isascii() and not any(c in text for c in "\t\n\r\v\f\x1c\x1d\x1e\x1f"):
            return text, False
        seen = "".join(" " if c.isspace() else "-" if c in HYPHENS else c for c in text if not invisible(c))
        words, start, mixed = [], 0, False
        composed = "".join(CEDILLA.get(c, c) for c in unicodedata.normalize("NFC", seen))
        for i, ch in enumerate(composed + " "):
            if not (ch.isalpha() or unicodedata.combining(ch)):
                word = composed[start:i]
                if word and not word.isascii():
                    word = self.one_alphabet(word)
                    mixed = mixed or len({alphabet(c) for c in word} - {""}) > 1
                words += [word, ch]
                start = i + 1
        whole = "".join(words[:-1])
        if not whole.isascii():
            whole = "".join(unicodedata.normalize("NFKC", c) if unicodedata.category(c)[0] in "LN" or 0xFF00 <= ord(c) <= 0xFFEF else c for c in whole)
            whole = "".join(CEDILLA.get(c, c) for c in unicodedata.normalize("NFC", whole))
        return whole, mixed


_BASE = Lookalikes({})


def skeleton(text: str | None) -> str | None:
    """The skeleton by the pairs of this module alone."""
    return _BASE.skeleton(text)


def consistent(text: str | None) -> str | None:
    """Composed letters, comma letters, ordinary spaces and hyphens, nothing invisible, one alphabet a word; by the pairs of this module alone."""
    return _BASE.read(text)[0]


def prototype_table(spark: SparkSession) -> dict[str, str]:
    """Every character of the public look-alike data with its prototype, as Spark's own Unicode library has it; an error where that cannot tell."""
    sc = spark.sparkContext
    found = getattr(sc, "_dosarium_lookalikes", None)
    if found is None:
        letters = [chr(c) for c in range(0x21, sys.maxunicode) if unicodedata.category(chr(c))[0] in "LNPS"]
        letters = [c for c in letters if not (0x3400 <= ord(c) <= 0x9FFF or 0xAC00 <= ord(c) <= 0xD7A3 or ord(c) >= 0x20000)]  # ideographs and syllables
        try:
            checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            whole = checker.getSkeleton("\n".join(letters))
        except (TypeError, Py4JError) as error:
            raise RuntimeError("the look-alike data cannot be read: com.ibm.icu.text.SpoofChecker is missing from Spark's jars or failed") from error
        prototypes = whole.split("\n")
        if len(prototypes) != len(letters):
            raise RuntimeError(f"the look-alike data cannot be read: {len(prototypes)} prototypes for {len(letters)} characters")
        found = {c: p for c, p in zip(letters, prototypes) if p and p != c and p != unicodedata.normalize("NFD", c)}
        if not found:
            raise RuntimeError("the look-alike data cannot be read: no character has a prototype")
        sc._dosarium_lookalikes = found
    return found


_FORMS = T.StructType([T.StructField("skeleton", T.StringType()), T.StructField("form", T.StringType()), T.StructField("mixed", T.BooleanType())])


def lookalike_groups(values: DataFrame, column: str) -> DataFrame:
    """(value, skeleton, form, changed, originals): one row per distinct value.

    ``originals`` counts the distinct values of the skeleton's group; ``changed``
    tells whether the value differs from the form that its group's prototypes
    give in its own alphabet, or mixes alphabets beyond that. Nulls are left out.
    """
    sent = values.sparkSession.sparkContext.broadcast(prototype_table(values.sparkSession))  # fixed data, some 6,000 entries

    @F.pandas_udf(_FORMS)
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookalikes = Lookalikes(sent.value)
        for batch in batches:
            yield pd.DataFrame([(lookalikes.skeleton(v), *lookalikes.read(v)) for v in batch], columns=_FORMS.names)

    distinct = spread(values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct(), "value")
    read = materialise(distinct.withColumn("f", forms("value")).select("value", "f.skeleton", "f.form", "f.mixed"), "forms")  # once, though read twice
    groups = read.groupBy("skeleton").agg(F.count("*").alias("originals"))
    return read.join(groups, "skeleton").select("value", "skeleton", "form", ((F.col("form") != F.col("value")) | F.col("mixed")).alias("changed"), "originals")


def changed_records(rows: DataFrame, column: str, key: str) -> DataFrame:
    """(rec_id, value, form): the records whose value is not in the consistent form, once per key and value."""
    groups = lookalike_groups(rows, column).where("changed").select(F.col("value").alias("__value"), "form")
    picked = rows.select(F.col(key).alias("rec_id"), F.col(column).alias("value"))
    return picked.join(groups, picked["value"] == groups["__value"]).select("rec_id", "value", "form").distinct()
