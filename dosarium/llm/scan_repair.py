"""Repair of text from scanned pages: edge lines, broken words, misread characters.

Edge lines are found in each document by itself: lines that are alike, with
slips, about once a page, or two of them by turns, and stand beside page breaks;
and lines that give nothing but the numbers of the pages in order. Words broken at a line's
end are joined where the corpus knows the joined word better than the
hyphenated one. Misread words are found in SQL: every word has an anagram hash,
the sum of its characters' values, so a confusion of characters shifts it by a
fixed difference; rare words plus each difference are joined with the frequent
words, checked letter by letter, and the most frequent variant is the correction.

Misread numbers and dates go the same way by their shape, all digits being one
sign: the shape plus the differences of its letters that look like digits must
give a shape that is commoner.

Defined results: null and empty texts have no lines; texts of any length are
read whole; different texts of one id are read apart, equal ones once; ties
between variants go to the first in code point order; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

# Signs that break a word at a line's end, and words around a page's number.
BREAKS = "-¬‐­‑"
PAGE_LINE = re.compile(r"[\W_]*(?:(?:pagina|page|seite|página|pag|pg|p|blatt|s)\b\.?)?[\W_]*(\d{1,4})(?:\s*(?:/|of|din|von|de|sur|aus)\s*(\d{1,4}))?[\W_]*", re.I)
# What is read, and what stands on the page.
CONFUSIONS = [pair.split(">") for pair in """rn>m m>rn ri>n n>ri ii>u u>ii cl>d d>cl vv>w w>vv li>h h>li lt>k nn>m in>m iu>m ni>m 1>l l>1 1>i i>1 0>o o>0 5>s s>5 8>b b>8 9>g g>9 6>b 6>g 2>z z>2 4>a 3>e 7>t e>c c>e i>l l>i t>f f>t f>r h>b b>h u>n n>u u>v v>u o>c c>o a>o o>a e>o o>e i>j j>i y>v v>y q>g g>q t>l l>t r>n n>r s>a a>s e>a a>e rr>n fi>h fl>h |>l |>i !>l !>i 1>t ă>a â>a î>i ș>s ț>t ä>a ü>u ö>o é>e à>a a>ă i>î s>ș t>ț ț>t ş>ș ţ>ț ü>ii ü>ti f>ț f>ș ß>b ß>B""".split()]
#: A misread word is at least this many times rarer than the word it stands for.
RARER = 6
#: Shortest word of letters only that is corrected; shorter ones are other words too often.
SHORTEST = 4
#: Slips allowed between repeats of a running line, for each of its characters.
LINE_SLIPS = 0.12
_VALUE = 1 << 36
#: Letters that a line which gives only its page's number may have.
NUMBER_LETTERS = 12
#: Numbers of a line; a digit within a word is a slip in it.
_NUMBERS = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")

LINE = T.StructType(
    [
        T.StructField("input_id", T.LongType()),
        T.StructField("text_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("place", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("head", T.StringType()),
        T.StructField("tail", T.StringType()),
        T.StructField("goes_on", T.BooleanType()),
    ]
)


def alike(a: str, b: str, most: int) -> bool:
    """Edit distance of at most ``most``; only places that near one another are compared."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    last = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= most else {}
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            row[j] = min(last.get(j - 1, far) + (x != b[j - 1]), last.get(j, far) + 1, row.get(j - 1, far) + 1)
        if min(row.values(), default=far) > most:
            return False
        last = row
    return last.get(len(b), far) <= most


def _bare(line: str) -> str:
    """The line stripped; in very long ones runs of a sign are one sign."""
    return line.strip() if len(line) <= 100 else re.sub(r"([\W_])\1+", r"\1", line.strip())[:1000]


def page_numbers(lines: list[str], pages: int) -> set[int]:
    """Positions of lines that give only their page's number. One way of writing is chosen: the one that counts furthest."""
    styles: dict[str, list[tuple[int, int]]] = {}
    for i, line in enumerate(lines):
        # Anything longer than its first 1,000 signs without runs has more in it than a number.
        if len(line) > NUMBER_LETTERS and sum(map(str.isalpha, line[:1000])) > NUMBER_LETTERS:
            continue
        m = PAGE_LINE.fullmatch(_bare(line))
        if m and int(m[1]) <= pages and int(m[1]) > 0 and (m[2] is None or int(m[2]) == pages):
            styles.setdefault(re.sub(r"\d+", "9", line.strip().lower()), []).append((i, int(m[1])))
    best: list[int] = []
    rank = (0, 0)
    for style, found in styles.items():
        run, value = [], 0
        for i, v in found:
            if v > value and v <= value + 2:
                run.append(i)
                value = v
        # A bare number is a page's only where the pages are counted on.
        own = (len(run), style != "9")
        if run and own > rank and (style != "9" or len(run) >= max(1, pages - 1)):
            best, rank = run, own
    return set(best)


def _alike_groups(plain: dict[int, str], lines: list[str], pages: int) -> list[list[int]]:
    """Positions of lines that are alike, with slips, in groups of two and more. Numbers stay, but for that of the page, which counts up:
    in sentences and headings that come again they differ."""
    texts: dict[tuple[str, tuple[str, ...]], list[int]] = {}
    for i, text in plain.items():
        if len(text) >= 4:
            texts.setdefault((text, tuple(_NUMBERS.findall(lines[i]))), []).append(i)
    keys = sorted(texts, key=lambda k: len(k[0]))
    sizes = np.array([len(k[0]) for k in keys])
    counts = np.zeros((len(keys), 32), dtype=np.int16)
    for r, (text, _) in enumerate(keys):
        counts[r] = np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) % 32, minlength=32)
    parent = list(range(len(keys)))

    def root(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    for r, (text, numbers) in enumerate(keys):
        most = max(1, min(4, int(LINE_SLIPS * len(text))))
        end = int(np.searchsorted(sizes, len(text) + most, side="right"))
        # A slip changes the counts of at most two characters, so lines further apart in these need no comparison.
        for q in r + 1 + np.flatnonzero(np.abs(counts[r + 1 : end] - counts[r]).sum(axis=1) <= 2 * most):
            other, theirs = keys[q]
            if root(r) != root(q) and all(x == y or max(int(x), int(y)) <= pages for x, y in zip(numbers, theirs)) and alike(text, other, most):
                parent[root(int(q))] = root(r)
    groups: dict[int, list[int]] = {}
    for r, key in enumerate(keys):
        groups.setdefault(root(r), []).extend(texts[key])
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def _counts_up(group: list[int], lines: list[str], pages: int) -> bool:
    """Numbers that differ within the group grow from line to line, as those of pages do. A number with a slip in it is passed over."""
    read = [[int(x) for x in _NUMBERS.findall(lines[i])] for i in group]
    usual = Counter(map(len, read)).most_common(1)[0][0]
    for column in zip(*(r for r in read if len(r) == usual)):
        if len(set(column)) > 1 and any(x >= y for x, y in zip(column, column[1:])):
            return False
    return True


def _page_edges(order: list[int], length: int, pages: int, taken: set[int]) -> list[set[int]]:
    """Sets of positions, any one of which may be those beside page breaks: beside the page numbers, or at even distances."""
    if len(taken) >= max(2, pages - 1):
        whole = sorted({*order, *taken})
        at = [k for k, i in enumerate(whole) if i in taken]
        return [{whole[j] for k in [*at, -1, len(whole)] for j in range(k - 2, k + 3) if 0 <= j < len(whole)}]
    out = []
    # All pages but the last are of one height.
    for height in range(max(3, -(-length // pages)), max(3, (length - 1) // (pages - 1)) + 1):
        near = {k * height + d for k in range(pages + 1) for d in (-2, -1, 0, 1)} | {length - 1, length - 2}
        out.append({i for i in order if i in near})
    return out


def _smudged(a: str, b: str) -> bool:
    """Alike but for three tenths of their characters; compared by these characters' counts first, which tell most lines apart."""
    most = len(b) * 3 // 10
    return abs(len(a) - len(b)) <= most and sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) <= 2 * most and alike(a, b, most)


def running_lines(lines: list[str], pages: int, taken: set[int]) -> set[int]:
    """Positions of running headers and footers: lines alike about once a page, or two by turns, that stand where pages begin or end.

    As many repeats as pages are enough if one begins or ends the text. All others,
    also those missing or unreadable on a page, must stand beside page breaks.
    """
    if pages < 2:
        return set()
    plain = {i: re.sub(r"\s+", " ", re.sub(r"\d+", "9", line)).strip().lower() for i, line in enumerate(lines) if line.strip() and i not in taken}
    order = sorted(plain)
    if not order:
        return set()
    groups = _alike_groups(plain, lines, pages)
    ends = {order[0], order[-1]}
    out: set[int] = set()
    for group in groups:
        if len(group) == pages and ends & set(group):
            out |= set(group)
    length = len(lines)
    while length and not lines[length - 1].strip():
        length -= 1
    rank = {i: k for k, i in enumerate(order)}
    edges = _page_edges(order, length, pages, taken)
    rest = [g for g in groups if not out & set(g) and len(g) <= pages and _counts_up(g, lines, pages)]
    best: list[int] = []
    for near in edges:
        fit = [g for g in rest if set(g) <= near]
        for g in fit:
            # Two pages leave no distance to measure: the lines touch at the break. Of three pages, two are enough at the text's edge,
            # unless the line goes on with a sentence.
            enough = rank[g[1]] - rank[g[0]] == 1 if pages == 2 else len(g) == pages or len(g) == pages - 1 and not lines[g[0]].strip()[0].islower() and (pages > 3 or ends & set(g))
            if enough and len(g) > len(best):
                best = g
        for k, a in enumerate(fit):
            for b in fit[k + 1 :]:
                both = sorted([*a, *b])
                turns = sum((x in a) != (y in a) for x, y in zip(both, both[1:]))
                # One page's line may be missing, so one turn may be too.
                if pages >= 4 and pages - 1 <= len(both) <= pages and abs(len(a) - len(b)) <= 1 and turns >= len(both) - 1 - (len(both) < pages) and len(both) > len(best):
                    best = both
    out |= set(best)
    # A line too smudged to be alike stands where a page of its own has none.
    if 2 < len(out) < pages:
        for near in edges:
            if out <= near:
                left = [i for i in sorted(near - out) if len(plain.get(i, "")) >= 4 and any(_smudged(plain[i], plain[j]) for j in out)]
                if left:
                    out.add(left[0])
                    break
    # What makes up most of a text is its content.
    return out if 2 * sum(len(lines[i]) for i in out) <= sum(map(len, lines)) else set()


def read_lines(text: str, pages: int) -> list[tuple[int, str, str, str | None, str | None, bool]]:
    """(line_no, place, line, head, tail, goes_on): head and tail are the parts of a word broken at the line's end; goes_on tells
    that the line begins with such a tail."""
    lines = text.split("\n")
    numbers = page_numbers(lines, pages)
    running = running_lines(lines, pages, numbers)
    body = [i for i, line in enumerate(lines) if i not in numbers and i not in running and line.strip()]
    following = dict(zip(body, body[1:]))
    out = []
    tails: set[int] = set()
    for i, line in enumerate(lines):
        place = "page_number" if i in numbers else "header" if i in running else "body" if line.strip() else "blank"
        head = tail = None
        if place == "body" and i in following:
            a = re.search(rf"([^\W\d_]{{1,100}})[{BREAKS}]\s{{0,9}}$", line)
            b = re.match(r"\s*([^\W\d_]+)", lines[following[i]])
            if a and b and b[1][0].islower():
                head, tail = a[1], b[1]
                tails.add(following[i])
        out.append((i + 1, place, line, head, tail, i in tails))
    return out


def document_lines(docs: DataFrame, key: str, column: str, pages: str) -> DataFrame:
    """Every line of every text with its place, stored in the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text_id, text, n in batch.itertuples(index=False):
                if text:
                    rows += [(k, text_id, *line) for line in read_lines(text, int(n) if n == n and n is not None else 1)]
                    if len(rows) > 100_000:
                        yield pd.DataFrame(rows, columns=LINE.names)
                        rows = []
            yield pd.DataFrame(rows, columns=LINE.names)

    picked = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(column).alias("h"), F.col(column).alias("t"), F.coalesce(F.col(pages), F.lit(1)).alias("n"))
    return materialise(picked.mapInPandas(run, LINE), "lines")


def anagram_hash(word: Column) -> Column:
    """The sum of the characters' values; equal for anagrams, shifted by a fixed difference for a confusion."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(c), F.lit(_VALUE))))


def _unbroken() -> Column:
    """A line without the parts of broken words at its ends."""
    ended = F.when(F.col("head").isNotNull(), F.regexp_replace("line", rf"[\p{{L}}]{{1,100}}[{BREAKS}]\s{{0,9}}$", "")).otherwise(F.col("line"))
    return F.when(F.col("goes_on"), F.regexp_replace(ended, r"^\s*[\p{L}]+", "")).otherwise(ended)


def line_words(lines: DataFrame) -> DataFrame:
    """(input_id, text_id, line_no, word): the words of the body, each occurrence, without the parts of broken words; stored in the shared folder."""
    body = lines.where("place = 'body'")
    words = F.regexp_extract_all(_unbroken(), F.lit(r"[\p{L}\p{N}|!]*[\p{L}\p{N}][\p{L}\p{N}|]*"), F.lit(0))
    return materialise(body.select("input_id", "text_id", "line_no", F.explode(words).alias("word")), "tokens")


def vocabulary(lines: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, n): lower-case words of the body, hyphenated ones whole and in parts, broken ones not; stored in the shared folder."""
    hyphenated = lines.where("place = 'body'").where(F.contains("line", F.lit("-"))).select(F.lower(_unbroken()).alias("line"))
    double = hyphenated.select(F.explode(F.regexp_extract_all("line", F.lit(r"(?<!\p{L})\p{L}{1,60}+-\p{L}{1,60}"), F.lit(0))).alias("word"))
    return materialise(tokens.select(F.lower("word").alias("word")).unionByName(double).groupBy("word").agg(F.count("*").alias("n")), "words")


def broken_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(input_id, text_id, line_no, head, tail): breaks whose sign is no part of the word: the corpus has the joined word at least as often as the hyphenated one."""
    cut = lines.where("head is not null").select("input_id", "text_id", "line_no", "head", "tail", F.lower(F.concat("head", "tail")).alias("joined"), F.lower(F.concat("head", F.lit("-"), "tail")).alias("compound"))
    known = cut.join(words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left").join(words.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
    return known.where(F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_compound", F.lit(0))).select("input_id", "text_id", "line_no", "head", "tail")


def _shifts(spark: SparkSession, pairs: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """(wrong, true, shift): what a confusion adds to the hash of the word that it is undone in; the fixed pairs, worked out once."""
    rows = spark.createDataFrame(pairs, "wrong string, true string").select("wrong", "true", anagram_hash(F.col("true")) - anagram_hash(F.col("wrong")))
    return sorted(tuple(r) for r in rows.collect())


def corrections(words: DataFrame) -> DataFrame:
    """(word, right): misread words with the frequent word that each stands for."""
    hashed = materialise(words.where(~F.contains("word", F.lit("-"))).withColumn("h", anagram_hash(F.col("word"))), "vocabulary")
    letters = F.col("word").rlike(r"^\p{L}+$")
    good = hashed.where(letters & (F.length("word") >= 2) & (F.col("n") > 1)).select("h", F.col("word").alias("right"), F.col("n").alias("n_right"))
    odd = F.col("word").rlike(r"\p{L}") & (letters & (F.length("word") >= SHORTEST) | F.col("word").rlike(r"[\p{N}|!]") & (F.length("word") >= 2))
    table = [F.struct(F.lit(a).alias("wrong"), F.lit(b).alias("true"), F.lit(n).cast("long").alias("shift")) for a, b, n in _shifts(words.sparkSession, sorted({(a, b) for a, b in CONFUSIONS}))]
    held = F.filter(F.array(*table), lambda c: F.contains(F.col("word"), c["wrong"]))  # those of the list that the word has
    tried = hashed.where(odd).select("word", "n", "h", F.explode(held).alias("c")).select("word", "n", "c.wrong", "c.true", (F.col("h") + F.col("c.shift")).alias("h"))
    met = tried.join(good, "h").where((F.col("n_right") >= RARER * F.col("n")) & (F.col("right") != F.col("word")))
    # Equal hashes only say that the letters are the same ones; the confusion must also give the word at some place.
    places = F.sequence(F.lit(1), F.length("word") - F.length("wrong") + 1)
    size = F.length("wrong")
    fits = F.exists(places, lambda i: (F.substring(F.col("word"), i, size) == F.col("wrong")) & (F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.col("true"), F.substring(F.col("word"), i + size, F.length("word"))) == F.col("right")))
    return met.where(fits).groupBy("word").agg(F.max(F.struct("n_right", "right")).alias("r")).select("word", F.col("r.right").alias("right"))


#: A number or a date with letters that look like digits in it, and the digits that these stand for.
_NUMBER = r"^(?=.*[0-9])(?=.*[OoIlSBZgqDQ|])[0-9OoIlSBZgqDQ|]+$"
_DIGITS = ("OoIlSBZgqDQ|", "001158299001")


def misread_numbers(tokens: DataFrame) -> DataFrame:
    """(input_id, line_no, word, right): numbers and dates whose shape, the differences of their letters added, is a commoner shape."""
    digits = r"[0-9]"
    shaped = tokens.where(F.col("word").rlike(r"^[0-9OoIlSBZgqDQ|]+$") & F.col("word").rlike(digits) & (F.length("word") >= 2)).withColumn("shape", F.regexp_replace("word", digits, "9"))
    shapes = materialise(shaped.groupBy("shape").agg(F.count("*").alias("n")).withColumn("h", anagram_hash(F.col("shape"))), "shapes")
    letters = F.create_map(*[x for c, _, n in _shifts(tokens.sparkSession, [(c, "9") for c in _DIGITS[0]]) for x in (F.lit(c), F.lit(n).cast("long"))])
    shift = F.aggregate(F.split("shape", ""), F.lit(0).cast("long"), lambda s, c: s + F.coalesce(F.try_element_at(letters, c), F.lit(0).cast("long")))
    odd = shapes.where(F.col("shape").rlike(r"[^9]")).select("shape", "n", (F.col("h") + shift).alias("h"))
    plain = shapes.where(F.col("shape").rlike(r"^9+$")).select("h", F.col("n").alias("n_right"))
    known = odd.join(plain, "h").where("n_right > n").select("shape")
    return shaped.where(F.col("word").rlike(_NUMBER)).join(known, "shape", "left_semi").select("input_id", "text_id", "line_no", "word", F.translate("word", *_DIGITS).alias("right"))


def misread_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(input_id, text_id, line_no, word, right): misread common words, dates and numbers."""
    known = corrections(words)
    common = tokens.withColumn("low", F.lower("word")).join(known.withColumnRenamed("word", "low"), "low").select("input_id", "text_id", "line_no", "word", "right")
    return common.unionByName(misread_numbers(tokens)).groupBy("input_id", "text_id", "line_no", "word").agg(F.min("right").alias("right"))


def scan_noise(docs: DataFrame, key: str = "input_id", column: str = "document_text", pages: str = "n_pages") -> DataFrame:
    """(input_id, line_no, kind): header, page_number, hyphen and misread lines."""
    lines = document_lines(docs, key, column, pages)
    tokens = line_words(lines)
    words = vocabulary(lines, tokens)
    edges = lines.where("place in ('header', 'page_number')").select("input_id", "line_no", F.col("place").alias("kind"))
    hyphens = broken_words(lines, words).select("input_id", "line_no", F.lit("hyphen").alias("kind"))
    misread = misread_words(tokens, words).select("input_id", "line_no", F.lit("misread").alias("kind"))
    return edges.unionByName(hyphens).unionByName(misread).distinct()


REPAIRED = T.StructType([T.StructField("input_id", T.LongType()), T.StructField("text", T.StringType())])


def repair(docs: DataFrame, key: str = "input_id", column: str = "document_text", pages: str = "n_pages") -> DataFrame:
    """(input_id, text): every text as paragraphs, one a line: edge lines gone, broken words joined, misread words put right."""
    lines = document_lines(docs, key, column, pages)
    tokens = line_words(lines)
    words = vocabulary(lines, tokens)
    one = ["input_id", "text_id", "line_no"]
    fixes = misread_words(tokens, words).groupBy(*one).agg(F.collect_set(F.struct("word", "right")).alias("fixes"))  # at most a line's words
    joins = broken_words(lines, words).select(*one, F.lit(True).alias("joins")).distinct()
    marked = lines.distinct().join(fixes, one, "left").join(joins, one, "left").where("place in ('body', 'blank')")
    rows = marked.groupBy("input_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "place", "line", "fixes", F.coalesce("joins", F.lit(False)).alias("joins")))).alias("lines"))  # one document's lines

    @F.pandas_udf(T.StringType())
    def write(documents: pd.Series) -> pd.Series:
        return documents.map(_write)

    done = rows.select("input_id", "text_id", write("lines").alias("text"))
    every = docs.select(F.col(key).cast("long").alias("input_id"), F.xxhash64(column).alias("text_id")).distinct()
    return every.join(done, ["input_id", "text_id"], "left").select("input_id", F.coalesce("text", F.lit("")).alias("text"))


def _write(lines: list[dict]) -> str:
    paragraphs, held, joining = [], "", False
    for row in lines:
        if row["place"] == "blank":
            if held and not joining:
                paragraphs.append(held)
                held = ""
            continue
        line = row["line"].strip()
        for fix in row["fixes"] if row["fixes"] is not None else []:
            right = fix["right"].capitalize() if fix["word"][0].isupper() else fix["right"]
            line = re.sub(rf"(?<!\w){re.escape(fix['word'])}(?!\w)", lambda _: right, line)
        if row["joins"]:
            line = line.rstrip().rstrip(BREAKS)
        held = held + line if joining or not held else f"{held} {line}"
        joining = bool(row["joins"])
    return "\n".join([*paragraphs, held] if held else paragraphs)
