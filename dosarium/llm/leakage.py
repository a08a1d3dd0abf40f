"""Held-out passages in the training text, by a positional inverted index.

The index has one posting (term, doc, position) for every word of the corpus
that any test item uses. For each window of ``words`` consecutive item words
the lists of its two rarest terms are intersected after subtracting the words'
offsets; what is left is checked word by word at its exact positions, and runs
of at least ``words`` consecutive agreements are reported.

A word is a run of letters and digits after case and accents are taken off.

Defined results: null and empty texts hold nothing; items shorter than
``words`` words match nothing; repeated documents count each under its own id;
empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

#: Distinct test terms up to which the dictionary may be broadcast; beyond, it is joined by shuffle.
BROADCAST_TERMS = 500_000
#: Documents with a rarest term up to which their ids are sent to the tasks that read the index, so that only their postings are shuffled.
BROADCAST_DOCS = 1_000_000


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Letters whose compatible decomposition is one base letter or digit with marks, and those bases; made by rule."""
    marked, base = [], []
    for code in range(0xA0, min(sys.maxunicode, 0xFFFF)):
        ch = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        parts = [c for c in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != ch and parts[0].isalnum():
            marked.append(ch)
            base.append(parts[0])
    return "".join(marked), "".join(base)


def words(text: Column) -> Column:
    """The words of a text in order; empty for null."""
    plain = F.regexp_replace(F.translate(F.lower(text), *accent_table()), r"\p{M}+", "")
    return F.coalesce(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def item_words(items: DataFrame, key: str, column: str) -> DataFrame:
    """(item_id, off, term)"""
    return items.select(F.col(key).alias("item_id"), F.posexplode(words(F.col(column))).alias("off", "term")).distinct()


def build_index(docs: DataFrame, terms: DataFrame, key: str, column: str) -> DataFrame:
    """Postings (term_id, doc_id, pos) of the given terms (term_id, term), stored in the shared folder."""
    bounded = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    dictionary = F.broadcast(terms) if bounded else terms
    postings = docs.select(F.col(key).alias("doc_id"), F.posexplode(words(F.col(column))).alias("pos", "term")).join(dictionary, "term")
    return materialise(postings.select("term_id", "doc_id", "pos"), "postings")


def rarest_of_windows(items: DataFrame, postings: DataFrame, length: int) -> DataFrame:
    """(item_id, term_1, off_1, term_2, off_2): the two rarest words of each window of ``length`` words.

    ``items`` is (item_id, off, term_id, size). A word that no document has
    makes its windows impossible; they are left out.
    """
    counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
    weighed = items.join(counts, "term_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    windows = weighed.select("item_id", "term_id", "off", "n", F.explode(F.sequence(F.greatest(F.col("off") - length + 1, F.lit(0)), F.least(F.col("off"), F.col("size") - length))).alias("start"))
    ranked = windows.groupBy("item_id", "start").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term_id"))).alias("w"))  # at most ``length`` words each
    rarest, second = F.col("w")[0], F.col("w")[1]
    return ranked.where(rarest["n"] > 0).select("item_id", rarest["term_id"].alias("term_1"), rarest["off"].alias("off_1"), second["term_id"].alias("term_2"), second["off"].alias("off_2")).distinct()


def find_passages(docs: DataFrame, items: DataFrame, length: int = 12, doc_key: str = "doc_id", doc_column: str = "text", item_key: str = "item_id", item_column: str = "text") -> DataFrame:
    """(doc_id, item_id, words): the longest run of consecutive item words in each document, where it is ``length`` or more."""
    spoken = item_words(items, item_key, item_column)
    sizes = spoken.groupBy("item_id").agg((F.max("off") + 1).cast("int").alias("size")).where(F.col("size") >= length)
    spoken = spoken.join(sizes, "item_id")
    terms = spoken.groupBy("term").agg(F.xxhash64("term").alias("term_id"))
    spoken = materialise(spoken.select("item_id", "off", F.xxhash64("term").alias("term_id"), "size"), "items")
    postings = build_index(docs, terms.select("term", "term_id"), doc_key, doc_column)

    # Rarest first: where the rarest word of a window stands, its second rarest must stand at the right distance.
    windows = rarest_of_windows(spoken, postings, length)
    first = postings.withColumnRenamed("term_id", "term_1").join(F.broadcast(windows) if _small(windows) else windows, "term_1")
    first = first.select("item_id", "doc_id", F.col("term_2").alias("term_id"), (F.col("pos") - F.col("off_1")).alias("shift"), "off_1", (F.col("pos") - F.col("off_1") + F.col("off_2")).alias("pos"))
    first = materialise(first.where("pos >= 0"), "first")
    both = first.join(_of_docs(postings, first), ["term_id", "doc_id", "pos"], "left_semi").select("item_id", "doc_id", "shift", "off_1").distinct()
    both = materialise(both, "aligned")

    # The words around what was found, each at the position where it must stand.
    around = both.join(spoken, "item_id").where(F.abs(F.col("off") - F.col("off_1")) < length)
    due = around.select("item_id", "doc_id", "shift", "off", "term_id", (F.col("shift") + F.col("off")).alias("pos")).distinct()
    agreed = due.join(_of_docs(postings, both), ["term_id", "doc_id", "pos"], "left_semi")
    order = Window.partitionBy("item_id", "doc_id", "shift").orderBy("off")  # at most one row for each word of the item
    runs = agreed.withColumn("run", F.col("off") - F.row_number().over(order)).groupBy("item_id", "doc_id", "shift", "run").agg(F.count("*").alias("words"))
    return runs.where(F.col("words") >= length).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _of_docs(postings: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of the documents of ``found``, a stored table; all of them where these are too many to be sent to every task."""
    docs = found.select("doc_id").distinct()
    return postings.join(F.broadcast(docs), "doc_id", "left_semi") if docs.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS else postings


def find_near(docs: DataFrame, items: DataFrame, share: float = 0.8, spread: int = 2, doc_key: str = "doc_id", doc_column: str = "text", item_key: str = "item_id", item_column: str = "text") -> DataFrame:
    """(doc_id, item_id, share): proximity matches. Documents in which, within a stretch of ``spread`` times the
    item's length, at least ``share`` of the item's distinct words stand, in any order.

    Every place where a stretch may begin is looked at; terms are counted once a stretch.
    """
    spoken = item_words(items, item_key, item_column).select("item_id", "off", F.xxhash64("term").alias("term_id"), "term")
    sizes = spoken.groupBy("item_id").agg((F.max("off") + 1).cast("int").alias("size"), F.count_distinct("term_id").alias("n_terms"))
    # Less a trifle, so that a product which floats put above a whole number is that number.
    sizes = sizes.withColumn("least", F.greatest(F.ceil(F.col("n_terms") * share - 1e-9), F.lit(1)))
    postings = build_index(docs, spoken.select("term", "term_id").distinct(), doc_key, doc_column)
    held = spoken.select("item_id", "term_id").distinct()
    counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
    # A match may lack all but ``least`` of the terms, so it has one of the rarest of that many and one more.
    order = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "term_id")
    rare = held.join(counts, "term_id", "left").join(sizes, "item_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n_terms") - F.col("least") + 1)
    found = postings.join(rare.select("item_id", "term_id"), "term_id").select("item_id", "doc_id").distinct()
    spots = materialise(found.join(held, "item_id").join(postings, ["doc_id", "term_id"]).select("item_id", "doc_id", "term_id", "pos"), "spots")
    enough = spots.groupBy("item_id", "doc_id").agg(F.count_distinct("term_id").alias("m")).join(sizes, "item_id").where("m >= least").select("item_id", "doc_id", "size", "n_terms", "least")
    # One document's places of one item's words.
    placed = spots.join(enough, ["item_id", "doc_id"]).groupBy("item_id", "doc_id", "size", "n_terms", "least").agg(F.array_sort(F.collect_list(F.struct("pos", "term_id"))).alias("places"))

    @F.pandas_udf(T.IntegerType())
    def most(places: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([most_terms([(p["pos"], p["term_id"]) for p in x], int(n) * spread) for x, n in zip(places, size)], dtype="int32")

    full = placed.withColumn("m", most("places", "size")).where("m >= least")
    return full.select("doc_id", "item_id", (F.col("m") / F.col("n_terms")).alias("share"))


def most_terms(places: list[tuple[int, int]], length: int) -> int:
    """The most distinct terms within ``length`` positions; places are (position, term) in order."""
    held: Counter = Counter()
    start = best = 0
    for pos, term in places:
        held[term] += 1
        while places[start][0] <= pos - length:
            old = places[start][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            start += 1
        best = max(best, len(held))
    return best


def _small(windows: DataFrame) -> bool:
    return windows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
