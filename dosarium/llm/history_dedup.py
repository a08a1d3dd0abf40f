"""New batches against everything accepted before, without going through the history again.

The store keeps, for each accepted record only, its minwise band keys and its
signature with the words needed for the check. Both lie in hash partitions by
the record's numbers, which must agree exactly. A batch reads the partitions of
its own numbers, probes the buckets of its own keys there, verifies the
candidates, and appends the keys of the records that turn out to be new files.
A store is opened again by its path, in any session.

Two records name the same file if the numbers of path and name are the same and
their words agree one to one, apart from a slip in a word, a shortened word,
the order of the words, the spelling of the path and marks of a copy.

Hot groups: records with equal canonical text are collapsed before any key is
made; every bucket is refined by the numbers and by how many words path and
name have, which equal files have in common. Within a batch a bucket is
compared with its smallest ids at a time, ``LEADERS`` at first and ``GROWTH``
times as many in each further round, without those already linked; so a bucket
is never gathered in one task and a few rounds are enough for any size.

Defined results: records with null path and null name name no file and are
left out; a single null counts as the empty text; a null batch number comes
after all others; repeated rows count once, keys must be unique; empty
batches and tables give no links; only the named columns are read. A batch that
was not appended completely, because its writer died, is not part of the store.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, scratch_path
from .confusables import consistent

BANDS, ROWS = 16, 2
#: Hash partitions of a new store; more for a larger one. An existing store keeps its own number.
PARTS = 16
#: Smallest ids of a bucket that the others are compared with in the first round, and the growth from round to round.
LEADERS, GROWTH = 32, 8
#: The batch number of rows without one.
LAST = 2**31 - 1
#: Keys, and candidates, of a batch up to which they are sent to the tasks that read the store (some 60 and 100 bytes each); more are joined by a shuffle.
BROADCAST_KEYS, BROADCAST_ROWS = 1_000_000, 500_000
#: Parts of a bucket that are ranked by themselves before the bucket is.
SALTS = 16
#: Share of equal signature places below which a candidate is not looked at further: fewer than two places beyond those of the band that it shares.
LEAST_ESTIMATE = 4 / 32
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)

#: Words that a worker remembers; emptied when full.
KNOWN_WORDS = 200_000

# How systems and people mark a copy, before and after a name.
COPY_BEFORE = r"^(?:copie (?:a|la|de)|copy of|copia (?:de|lui)|kopie von|copie)[\s_\-]+"
COPY_AFTER = r"[\s_\-]*(?:\(\d{1,2}\)|[\s_\-](?:copie|copy|copia|kopie|dup|duplicat|duplicate)(?:[\s_\-]*\(?\d{1,2}\)?)?)$"
# Words that carry nothing of their own in a name.
SMALL_WORDS = frozenset("a de la pe cu din si in the nr".split())
# Words that mark a copy; with a slip in them they stay in a name.
COPY_WORDS = ("copie", "copy", "copia", "kopie", "duplicat")

RECORD = T.StructType(
    [
        T.StructField("canon", T.StringType()),
        T.StructField("numbers", T.StringType()),
        T.StructField("path_words", T.ArrayType(T.StringType())),
        T.StructField("name_words", T.ArrayType(T.StringType())),
        T.StructField("signature", T.ArrayType(T.IntegerType())),
        T.StructField("buckets", T.ArrayType(T.LongType())),
    ]
)


def fold(text: str) -> str:
    """Lower case without accents and look-alike letters."""
    plain = unicodedata.normalize("NFKD", consistent(text) or "")
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def _stem(name: str) -> str:
    """Without extension and marks of a copy."""
    name = re.sub(r"(?<=.)\.[a-z0-9]{1,5}$", "", name.strip())
    before = None
    while before != name:
        before = name
        name = re.sub(COPY_AFTER, "", re.sub(COPY_BEFORE, "", name.strip())) or name
    return name


def _decoded(path: str) -> str:
    """The path without percent escapes, where they give a valid text."""
    if not re.search("%[0-9A-Fa-f]{2}", path):
        return path
    try:
        return unquote(path, errors="strict")
    except UnicodeDecodeError:
        return path


def _words(text: str) -> list[str]:
    """The words that count: small words and words that mark a copy are left out, unless there are no others."""
    found = re.findall(r"[^\W\d_]+", text)
    kept = [w for w in found if w not in SMALL_WORDS and not (3 < len(w) < 12 and any(one_slip(w, c) for c in COPY_WORDS))]
    return kept or found


def canonical(path: str | None, name: str | None) -> tuple[str, str, list[str], list[str]]:
    """(canonical text, numbers, words of the path, words of the name)"""
    parts = [p for p in re.sub(r"[\\/]+", "/", fold(_decoded(path or ""))).strip().split("/") if p.strip() not in ("", ".")]
    if parts:
        parts[-1] = _stem(parts[-1])
    path_text, name_text = "/".join(parts), _stem(fold(name or ""))
    path_words, name_words = _words(path_text), _words(name_text)
    numbers = "".join(re.findall(r"\d", path_text)) + "|" + " ".join(sorted(re.findall(r"\d+", name_text)))
    canon = " ".join(path_words) + "|" + " ".join(sorted(name_words)) + "|" + numbers
    return canon, numbers, path_words, name_words


class _Signer:
    """Minwise values of words, remembered; the signature of a record is the least of its words' values place by place."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        """``word`` begins with a letter that tells whether it stands in the path or in the name."""
        found = self.known.get(word)
        if found is None:
            kind, padded = word[0], f" {word[1:]} "
            grams = {kind + padded[i : i + 3] for i in range(len(padded) - 2)} or {kind}
            h = np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), dtype=np.uint64, count=len(grams))
            with np.errstate(over="ignore"):
                found = np.full(BANDS * ROWS, np.iinfo(np.int32).max, dtype=np.int32)
                for at in range(0, len(h), 10_000):  # very long words in parts
                    found = np.minimum(found, ((h[at : at + 10_000, None] * _MUL[None, :] + _ADD[None, :]) >> np.uint64(33)).min(axis=0).astype(np.int32))
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            if len(word) < 100:
                self.known[word] = found
        return found

    def keys(self, numbers: str, path_words: list[str], name_words: list[str]) -> tuple[np.ndarray, list[int]]:
        """(signature, buckets): numbers and numbers of words must agree exactly, so they refine every bucket."""
        words = {"p" + w for w in path_words} | {"n" + w for w in name_words} or {"n"}
        least = self.word(words.pop())
        for w in words:
            least = np.minimum(least, self.word(w))
        refined = f"{numbers}#{len(path_words)}#{len(name_words)}#".encode()
        places = least.tobytes()
        step = 4 * ROWS
        return least, [xxhash.xxh64_intdigest(b"%b%d#%b" % (refined, b, places[b * step : (b + 1) * step])) - (1 << 63) for b in range(BANDS)]


@F.pandas_udf(RECORD)
def read_record(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    signer = _Signer()
    for paths, names in batches:
        rows = []
        for path, name in zip(paths, names):
            canon, numbers, pw, nw = canonical(path, name)
            least, buckets = signer.keys(numbers, pw, nw)
            rows.append((canon, numbers, pw, nw, least, buckets))
        yield pd.DataFrame(rows, columns=RECORD.names)


def one_slip(a: str, b: str) -> bool:
    """At most one letter added, lost, changed, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i:] == b[i + 1 :]


def _close(a: str, b: str) -> bool:
    """One slip apart, or equal but for letters typed twice."""
    return min(len(a), len(b)) >= 3 and (one_slip(a, b) or re.sub(r"(.)\1+", r"\1", a) == re.sub(r"(.)\1+", r"\1", b))


def _shortened(short: str, long: str) -> bool:
    """``short`` begins ``long``, or keeps its first letter and some others in order without its vowels."""
    if len(short) >= len(long) or short[:1] != long[:1]:
        return False
    if long.startswith(short):
        return True
    if any(c in "aeiou" for c in short) or len(short) < 2:
        return False
    rest = iter(long)
    return all(c in rest for c in short)


def same_words(a: list[str], b: list[str]) -> bool:
    """The words agree one to one, in any order, with slips and shortenings."""
    if len(a) != len(b):
        return False
    left, right = list(a), list(b)
    for w in a:
        if w in right:
            right.remove(w)
            left.remove(w)
    for w in left:
        for close in (lambda x: _close(w, x), lambda x: _shortened(w, x) or _shortened(x, w)):
            found = next((x for x in right if close(x)), None)
            if found is not None:
                right.remove(found)
                break
        else:
            return False
    return True


@F.pandas_udf(T.BooleanType())
def same_file(path_a: pd.Series, name_a: pd.Series, path_b: pd.Series, name_b: pd.Series) -> pd.Series:
    return pd.Series([same_words(list(pa), list(pb)) and same_words(list(na), list(nb)) for pa, na, pb, nb in zip(path_a, name_a, path_b, name_b)], dtype=bool)


def _estimate() -> F.Column:
    return F.aggregate(F.zip_with("signature", "other_signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(BANDS * ROWS)


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, a stored table, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _verified(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """The pairs (part, id, other) that name the same file, as (id, other, known)."""
    pairs = _few(materialise(pairs.distinct(), "candidates"))
    right = old.select("part", F.col("id").alias("other"), F.col("path_words").alias("other_path"), F.col("name_words").alias("other_name"), F.col("signature").alias("other_signature"), "known")
    left = new.select("part", "id", "path_words", "name_words", "signature")
    both = left.join(pairs, ["part", "id"]).join(right.join(pairs.select("part", "other").distinct(), ["part", "other"], "left_semi"), ["part", "other"])
    return both.where(_estimate() >= LEAST_ESTIMATE).where(same_file("path_words", "name_words", "other_path", "other_name")).select("id", "other", "known")


class History:
    """The stored keys and records of what was accepted, in a folder that all executors share. One writer at a time."""

    KEYS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("id", T.LongType()), T.StructField("part", T.IntegerType())])
    RECORDS = T.StructType([T.StructField("id", T.LongType()), *[f for f in RECORD.fields if f.name in ("path_words", "name_words", "signature")], T.StructField("part", T.IntegerType())])

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int = PARTS):
        self.spark, self.path, self.parts, self.batches = spark, path or scratch_path(spark, "history"), parts, 0
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if self._exists("parts"):
            self.parts = spark.read.parquet(f"{self.path}/parts").first()["parts"]
        else:
            spark.createDataFrame([(parts,)], "parts int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts")
        # The keys of a batch are written last.
        while self._exists(f"keys/batch={self.batches}"):
            self.batches += 1

    def _exists(self, what: str) -> bool:
        return self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/_SUCCESS"))

    def part(self) -> F.Column:
        """The hash partition of a record."""
        return F.pmod(F.xxhash64("numbers"), F.lit(self.parts)).cast("int")

    def read(self, what: str, parts: list[int]) -> DataFrame:
        """Keys or records of the given partitions only."""
        schema = self.KEYS if what == "keys" else self.RECORDS
        if not self.batches:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}")
        return reader.parquet(*[f"{self.path}/{what}/batch={b}" for b in range(self.batches)]).where(F.col("part").isin(parts)).select(*schema.names)

    def append(self, accepted: DataFrame) -> None:
        """Store a batch; hot partitions are spread over tasks and files."""
        keys = accepted.select(F.explode(F.array_distinct("buckets")).alias("bucket"), "id", "part")
        for what, rows in (("records", accepted.select(*self.RECORDS.names)), ("keys", keys)):
            rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{what}/batch={self.batches}")
        self.batches += 1

    def add_batch(self, batch: DataFrame) -> DataFrame:
        """Take in one batch, as ``read_records`` gives it. Returns (id, first): the accepted record of every
        record of the batch that names a file accepted before it; the others are accepted now."""
        firsts = materialise(collapse(batch.withColumn("batch", F.lit(0)), ["batch"]).withColumn("part", self.part()), "firsts")
        sizes = {r["part"]: r["count"] for r in firsts.groupBy("part").count().collect()}  # no more than the store has
        pairs, hot = own_pairs(firsts)
        links = self.add_firsts(firsts, list(sizes), sum(sizes.values()), pairs, None if hot.isEmpty() else hot)
        return materialise(with_copies(links, firsts, batch, []), "found")

    def probe(self, firsts: DataFrame, parts: list[int], size: int) -> DataFrame:
        """(part, id, other): the records of the store that share a bucket with one of the ``size`` of the batch."""
        asked = firsts.select("part", "id", F.explode(F.array_distinct("buckets")).alias("bucket"))
        if size * BANDS <= BROADCAST_KEYS:
            asked = F.broadcast(asked)
        # Equal buckets have equal numbers, so they lie in one partition.
        return self.read("keys", parts).select("bucket", F.col("id").alias("other")).join(asked, "bucket").select("part", "id", "other")

    def add_firsts(self, firsts: DataFrame, parts: list[int], size: int, pairs: DataFrame, hot: DataFrame | None) -> DataFrame:
        """(id, first) of a batch of ``size`` distinct canonical texts, which lies in a table, with its pairs and hot buckets as ``own_pairs`` gives them."""
        known = self.read("records", parts).withColumn("known", F.lit(True))
        own = firsts.select(*self.RECORDS.names).withColumn("known", F.lit(False))
        pairs = pairs.select("part", "id", "other")
        if self.batches:
            pairs = pairs.unionByName(self.probe(firsts, parts, size))
        if hot is None:
            found = _verified(pairs, own, known.unionByName(own))
        else:
            waiting, leaders = hot.select("part", "id", "bucket"), LEADERS
            found = materialise(_verified(pairs.unionByName(_led(waiting, leaders)), own, known.unionByName(own)), "links")
            while True:
                # Buckets with more members than the round compared: again, without the leaders and those linked.
                rest = waiting.join(found.select("id").distinct(), "id", "left_anti")
                waiting = materialise(rest.join(_leaders(waiting, leaders), ["bucket", "id"], "left_anti"), "waiting")
                if waiting.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                    break
                leaders *= GROWTH
                found = materialise(found.unionByName(_verified(_led(waiting, leaders), own, own)), "links")
        # What the store has goes before what the batch itself has.
        best = found.groupBy("id").agg(F.min(F.struct(~F.col("known"), "other")).alias("b")).select("id", F.col("b.other").alias("other"))
        links = resolve(materialise(best, "best"))
        self.append(firsts.join(links, "id", "left_anti"))
        return links.withColumnRenamed("other", "first")


def own_pairs(firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (batch, part, id, other) within the buckets of each batch, and the members (batch, part, id, bucket) of the hot buckets, those with more than ``LEADERS``."""
    keys = firsts.select("batch", "part", "id", F.explode(F.array_distinct("buckets")).alias("bucket"))
    shared = materialise(keys.groupBy("batch", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = materialise(keys.join(_few(shared), ["batch", "bucket"]), "members")
    small = members.where(F.col("n") <= LEADERS).groupBy("batch", "part", "bucket").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most LEADERS ids
    pairs = small.select("batch", "part", F.posexplode("ids").alias("at", "id"), "ids").select("batch", "part", "id", F.explode(F.slice("ids", F.lit(1), F.col("at"))).alias("other"))
    return materialise(pairs.distinct(), "pairs", ["batch"]), members.where(F.col("n") > LEADERS).select("batch", "part", "id", "bucket")


def collapse(records: DataFrame, by: list[str]) -> DataFrame:
    """The first record of each canonical text (and each value of ``by``)."""
    others = [F.col(c) for c in records.columns if c not in ("canon", *by)]
    return records.groupBy(*by, "canon").agg(F.min_by(F.struct(*others), "id").alias("r")).select(*by, "canon", "r.*")


def with_copies(links: DataFrame, firsts: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, first) of all records: each is linked through the first of its own canonical text, or is that one's copy."""
    heads = firsts.select(*[F.col(c).alias(f"h_{c}") for c in (*by, "canon")], F.col("id").alias("head")).join(links.select(F.col("id").alias("head"), "first"), "head", "left")
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in (*by, "canon")])
    return records.join(heads, same).select(*by, "id", F.coalesce("first", "head").alias("first")).where("first < id").distinct()


def _leaders(waiting: DataFrame, most: int) -> DataFrame:
    """(bucket, id): the ``most`` smallest ids of each bucket, ranked in parts first, so that no task ranks a hot bucket alone."""
    part = waiting.select("bucket", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = part.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("id"))).where(F.col("r") <= most)
    return some.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).where(F.col("r") <= most).select("bucket", "id")


def _led(waiting: DataFrame, most: int) -> DataFrame:
    """(part, id, other): the pairs of each bucket's members with its smallest ids."""
    lead = _leaders(waiting, most).select("bucket", F.col("id").alias("other"))
    return waiting.join(lead, "bucket").where(F.col("other") < F.col("id")).select("part", "id", "other")


def resolve(links: DataFrame) -> DataFrame:
    """Follow (id, other) to records that are not linked themselves."""
    while True:
        up = links.select(F.col("id").alias("other"), F.col("other").alias("up"))
        if links.join(up, "other", "left_semi").isEmpty():
            return links
        links = materialise(links.join(up, "other", "left").select("id", F.coalesce("up", "other").alias("other")), "resolved")


def read_records(rows: DataFrame, key: str, path: str, name: str, batch: str) -> DataFrame:
    """(id, batch, canon, numbers, path_words, name_words, signature, buckets); no batch number is the greatest."""
    picked = rows.where(F.col(path).isNotNull() | F.col(name).isNotNull())
    picked = picked.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(batch).cast("int"), F.lit(LAST)).alias("batch"), F.col(path).alias("p"), F.col(name).alias("n"))
    return picked.withColumn("r", read_record("p", "n")).select("id", "batch", "r.*")


def dedup_batches(rows: DataFrame, key: str = "id", path: str = "original_path", name: str = "ai_proposed_name", batch: str = "batch_no", history: History | None = None) -> DataFrame:
    """(id, first, batch): every record that names a file accepted before it, with that file's first record.

    Batches are taken in by their number; each probes the store and appends to it.
    """
    spark = rows.sparkSession
    history = history or History(spark)
    records = materialise(read_records(rows, key, path, name, batch), "records")
    firsts = materialise(collapse(records, ["batch"]).withColumn("part", history.part()), "firsts", ["batch"])
    parts = firsts.groupBy("batch").agg(F.collect_set("part").alias("parts"), F.count("*").alias("size")).collect()  # a row a batch: its partitions, no more than the store has
    pairs, hot = own_pairs(firsts)
    held = {r["batch"] for r in hot.select("batch").distinct().collect()}  # batches again
    found = [spark.createDataFrame([], "id long, first long")]
    for number, own, size in sorted((r["batch"], r["parts"], r["size"]) for r in parts):
        of = F.col("batch") == number
        found.append(history.add_firsts(firsts.where(of).drop("batch"), own, size, pairs.where(of), hot.where(of) if number in held else None))
    links = functools.reduce(DataFrame.unionByName, found)
    return with_copies(links, firsts, records, ["batch"]).select("id", "first", F.nullif("batch", F.lit(LAST)).alias("batch"))
