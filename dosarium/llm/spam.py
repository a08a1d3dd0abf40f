"""Pages of repeated keywords, links or product tags, by the coherence of neighbouring words.

The pointwise mutual information of two neighbouring words takes how likely the
second follows the first from the bigram counts of the whole corpus, and how
likely the second is at all from the document itself, the word's own occurrence
left out and smoothed by the corpus. In sentences the order of words tells much
about the next one; in word salad and in collocations that a page repeats over
and over it tells nothing. The mean over a stretch of some thirty words is its
coherence; a document is flagged by the share of its characters that stand in
incoherent stretches.

Links, hash tags, product codes and numbers each count as one word. Lines of
numbered or dashed lists count as coherent, unless they hold links, tags or
repeated keywords or are as long as a stretch; these are read without their
markers like any other text.

Defined results: null, empty and very short texts (fewer than ``LEAST_WORDS``
words outside ordinary lists) are never flagged; long texts are read whole; a repeated
id gives one row for each of its texts' chunks together, so ids must be unique;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

STRETCH = 30
#: Coherence, in nats, below which a stretch counts as incoherent whatever it says: its collocations are the page's only ones.
LEAST_COHERENCE = 1.45
#: Coherence below which a stretch counts as incoherent if its words also follow one another by chance: the mean
#: log likelihood of the next word is below CHANCE. A sentence that a page repeats is coherent in this sense.
LOW_COHERENCE, CHANCE = 2.5, -2.3
#: Share of the characters in incoherent stretches above which a document is flagged; a stray sentence fits beside it.
MOST_INCOHERENT = 0.7
LEAST_WORDS = 10
#: Distinct pairs of neighbours up to which all are broadcast, and the most that may be frequent: each of these has a larger share than one in so many.
BROADCAST_BIGRAMS, MOST_FREQUENT = 500_000, 10_000
#: Weight of the corpus against the document's own word counts, in words.
SMOOTHING = 20

_LINK = re.compile(r"\[[^\]\n]{0,200}\]\(https?\S+|(?:\b[^\W\d_]{1,40}[ \w]{0,40}: )?https?://\S+|www\.\S+")
_TAG = re.compile(r"#\w+")
_CODE = re.compile(r"\b[a-z]\d+\b")
_WORD = re.compile(r"§[uhc]|[^\W\d_]+|\d[\d.,/-]*")
_LIST = re.compile(r"\s*(?:\d+(?:\.\d+)*[.)]?|[-*•>|])\s")
_MARKERS = re.compile(rf"(?:{_LIST.pattern})+")
#: A word that stands so often in a text's list lines is a keyword there; so much of a line must be keywords.
OFTEN, MOST_KEYWORDS = 3, 0.8


def _read(line: str) -> list[str]:
    """Words of a line; links, tags, codes and numbers as signs."""
    plain = line.lower()
    if "http" in plain or "www." in plain:
        plain = _LINK.sub(" §u ", plain)
    if "#" in plain:
        plain = _TAG.sub(" §h ", plain)
    return ["§n" if w[0].isdigit() else w for w in _WORD.findall(_CODE.sub(" §c ", plain))]


def _no_list(words: list[str], often: Counter) -> bool:
    """What a list line holds is links and tags, or keywords that the list lines repeat. Lines with numbers, as of invoices and contents, are ordinary."""
    signs = sum(w in ("§u", "§h", "§c") for w in words)
    if 2 * signs > len(words):
        return True
    return bool(words) and "§n" not in words and sum(often[w] >= OFTEN for w in words) >= MOST_KEYWORDS * len(words)


def stretches(text: str) -> list[tuple[list[str], int]]:
    """(words, characters) of each stretch in order; ordinary list lines have no words. Neighbouring stretches of a line share a word,
    so that every pair of neighbours is in one of them."""
    out: list[tuple[list[str], int]] = []
    held: list[str] = []
    size = 0
    lines = [line for line in text.split("\n") if line.strip()]
    listed = {i: _read(line[m.end() :]) for i, line in enumerate(lines) if (m := _MARKERS.match(line))}
    often = Counter(w for words in listed.values() for w in words)
    for i, line in enumerate(lines):
        # What is as long as a stretch is text, whatever it begins with.
        if i in listed and len(listed[i]) < STRETCH and not _no_list(listed[i], often):
            out.append(([], len(line)))
            continue
        words = listed[i] if i in listed else _read(line)
        if len(words) >= 10:
            if held:
                out.append((held, size))
                held, size = [], 0
            parts = max(1, round(len(words) / STRETCH))
            step = len(words) / parts
            for i in range(parts):
                out.append((words[int(i * step) : int((i + 1) * step) + 1], len(line) * (i + 1) // parts - len(line) * i // parts))
        else:
            held, size = held + words, size + len(line)
            if len(held) >= STRETCH:
                out.append((held, size))
                held, size = [], 0
    if held or size:
        out.append((held, size))
    return out


PAIRS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("stretch", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("a", T.LongType()),
        T.StructField("b", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("own", T.IntegerType()),
        T.StructField("words", T.IntegerType()),
    ]
)
_ARROW = pa.schema([("doc_id", pa.int64()), ("stretch", pa.int32()), ("size", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("words", pa.int32())])


class _Signs(dict):
    """The hash of each word, remembered; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) - (1 << 63)
        return h


def _pairs(key: int, text: str, signs: _Signs) -> np.ndarray | None:
    """The rows of one document, a column each; None for very short texts. A row of n = 0 stands for each stretch."""
    parts = stretches(text)
    words = [signs[w] for own, _ in parts for w in own]
    total = len(words)
    if total < LEAST_WORDS:
        return None
    codes = np.array(words, dtype=np.int64)
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    lengths = np.array([len(own) for own, _ in parts])
    sizes = np.array([size for _, size in parts])
    of = np.repeat(np.arange(len(parts)), lengths)
    # Neighbours of one stretch that is long enough to tell.
    here = np.flatnonzero((of[1:] == of[:-1]) & (lengths[of[:-1]] >= 4))
    # Equal neighbours of a stretch are one row.
    keyed = (of[here] * len(counts) + inverse[here]) * len(counts) + inverse[here + 1]
    _, first, n = np.unique(keyed, return_index=True, return_counts=True)
    at = here[first]
    rows = np.zeros((8, len(parts) + len(at)), dtype=np.int64)
    rows[0], rows[7] = key, total
    rows[1, : len(parts)], rows[2, : len(parts)] = np.arange(len(parts)), sizes
    rows[1, len(parts) :], rows[2, len(parts) :] = of[at], sizes[of[at]]
    rows[3, len(parts) :], rows[4, len(parts) :] = codes[at], codes[at + 1]
    rows[5, len(parts) :], rows[6, len(parts) :] = n, counts[inverse[at + 1]]
    return rows


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signs, held, size = _Signs(), [], 0

    def sent() -> pa.RecordBatch:
        rows = np.concatenate(held, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole = text.as_py()
            rows = _pairs(doc, whole, signs) if whole and doc is not None else None
            if rows is not None:
                held.append(rows)
                size += rows.shape[1]
            if size >= 200_000:
                yield sent()
                held, size = [], 0
    if held:
        yield sent()


def coherence(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, stretch, size, mean_pmi, mean_next): every stretch of every document; the means are null for lists and very few words."""
    rows = materialise(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text")).mapInArrow(_emit, PAIRS), "pairs")
    pairs = rows.where("n > 0")
    counts = materialise(pairs.groupBy("a", "b").agg(F.sum("n").alias("c_ab")), "bigrams")
    words = counts.groupBy("a").agg(F.sum("c_ab").alias("c"))
    total = counts.agg(F.sum("c_ab").alias("total"))  # one row
    known = counts.join(words.select("a", F.col("c").alias("c_a")), "a").join(words.select(F.col("a").alias("b"), F.col("c").alias("c_b")), "b", "left").crossJoin(F.broadcast(total))
    follows = known.select("a", "b", F.log(F.col("c_ab") / F.col("c_a")).alias("follows"), (F.coalesce("c_b", F.lit(1)) / F.col("total")).alias("p_b"), (F.col("c_ab") * MOST_FREQUENT > F.col("total")).alias("frequent"))
    scored = _scored(pairs, materialise(follows, "follows"))
    pmi = F.col("follows") - F.log((F.col("own") - 1 + SMOOTHING * F.col("p_b")) / (F.col("words") - 1 + SMOOTHING))
    means = scored.groupBy("doc_id", "stretch").agg((F.sum(pmi * F.col("n")) / F.sum("n")).alias("mean_pmi"), (F.sum(F.col("follows") * F.col("n")) / F.sum("n")).alias("mean_next"))
    return rows.where("n = 0").select("doc_id", "stretch", "size").join(means, ["doc_id", "stretch"], "left")


def _scored(pairs: DataFrame, follows: DataFrame) -> DataFrame:
    """Every pair beside what the corpus knows of it. Few bigrams are broadcast; of more, only the frequent ones, of which there are less
    than ``MOST_FREQUENT``, so that no key of the shuffle has more than one in ``MOST_FREQUENT`` of all pairs."""
    if follows.limit(BROADCAST_BIGRAMS + 1).count() <= BROADCAST_BIGRAMS:
        return pairs.join(F.broadcast(follows), ["a", "b"])
    frequent = F.broadcast(follows.where("frequent").select("a", "b", F.col("follows").alias("f"), F.col("p_b").alias("p")))
    marked = pairs.join(frequent, ["a", "b"], "left")
    hot = marked.where("f is not null").select(*pairs.columns, F.col("f").alias("follows"), F.col("p").alias("p_b"))
    rest = marked.where("f is null").select(*pairs.columns).join(follows.where("not frequent").select("a", "b", "follows", "p_b"), ["a", "b"])
    return hot.unionByName(rest)


def incoherent_pages(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, share, mean_pmi, spam): the share of characters in incoherent stretches, and whether it makes the page spam."""
    per = coherence(docs, key, column)
    chance = (F.col("mean_pmi") < LOW_COHERENCE) & (F.col("mean_next") < CHANCE)
    low = F.sum(F.when((F.col("mean_pmi") < LEAST_COHERENCE) | chance, F.col("size")).otherwise(0))
    shares = per.groupBy("doc_id").agg((low / F.greatest(F.sum("size"), F.lit(1))).alias("share"), F.avg("mean_pmi").alias("mean_pmi"))
    return shares.withColumn("spam", F.col("share") > MOST_INCOHERENT)
