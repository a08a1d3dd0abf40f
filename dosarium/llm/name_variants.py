"""Linking the spellings of one person or organisation.

Each distinct spelling is read into its words, its initials and shortenings.
Blocks are suffixes of words of a minimum length; names with a common word meet
by their other words less one letter instead.
Pairs are compared word by word by the ratio of their longest common
subsequence. Spellings that give the whole name are joined into names; short
forms (initials, shortened words, pet names, a first word alone) go to the only
name that they can stand for.

Defined results: null, empty and ``N/A`` values are left out; a value that
stands for nothing else has no partner; very long values are compared whole; an
empty table gives no pairs; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .confusables import consistent

LEAST_SUFFIX = 4
#: Words of this many letters and more are keyed by their letters whatever the order, and by suffixes no longer than this.
LONG = 100
#: Spellings that share a key up to which all their pairs are compared. Those of larger groups meet by finer keys, which keep every pair
#: that the comparison would take, so the links are the same on either side.
COMMON = 60
_VALUE = 1 << 36

# Forms of address and titles.
TITLES = frozenset("dr prof ing av avocat dl dna d na domnul doamna mr mrs ms miss herr frau m mme mlle sr sra lect conf arh ec jr sir dipl phd drd".split()) - {"d", "na", "m"}
# Legal forms and what stands for "company".
FORMS = {"srl": "srl", "sa": "sa", "snc": "snc", "scs": "scs", "gmbh": "gmbh", "ag": "ag", "kg": "kg", "ltd": "ltd", "limited": "ltd", "llc": "llc", "inc": "inc", "plc": "plc", "sarl": "sarl", "sas": "sas", "sl": "sl", "bv": "bv", "spa": "spa", "pfa": "pfa", "ong": "ong"}
COMPANY = frozenset("sc societatea firma compania grupul company the".split())
# Pet names by given name.
PET_NAMES = {
    "alexandru": "alex sandu alecu sandi xandru", "alexandra": "alexa sanda", "andrei": "andi", "anca": "ancuta", "bogdan": "bogdi dani bobo", "constantin": "costel dinu costi titi costica", "cristian": "cristi", "cristina": "cristi tina",
    "daniel": "dani dan", "dumitru": "mitica dumi mitru dima", "ecaterina": "cati catinca katy rina", "elena": "lena leni ela", "elisabeta": "beti veta eliza lisa saveta", "felicia": "feli", "gabriela": "gabi ela", "gabriel": "gabi", "gheorghe": "ghita gogu gigi george geo gica", "grigore": "grig",
    "horatiu": "hori horia", "ioana": "ioni oana", "ion": "nelu ionel ionica", "ioan": "nelu ionel", "iuliana": "iuli lia liana iulia", "iulian": "iuli", "josephine": "josie jo josi sefi", "katharina": "kathe kathi kati ina", "laurentiu": "lentu lauri renti", "magdalena": "magda lena leni", "maria": "mimi marica mia", "mihail": "misu mihai mihaita misa", "mihai": "misu",
    "michael": "mike mick", "nicolae": "nicu nae niculae nelu", "octavian": "tavi octav", "petronela": "nela petra", "petru": "petrica petre", "raymond": "ray", "robert": "bob rob bobby", "richard": "dick rick", "rodica": "rodi ica", "stefan": "fane stef fanel fanica", "teodora": "dora teo tea", "teodor": "teo doru", "ulrich": "uli ulli ricky", "vasile": "vasilica vasi lica lelu",
    "victor": "vichi vic", "william": "bill will willy billy liam", "yolanda": "yola yoli", "zaharia": "zaha zachi", "elizabeth": "liz beth betty", "margaret": "maggie peg", "thomas": "tom", "james": "jim", "john": "jack johnny", "johann": "hans", "friedrich": "fritz", "heinrich": "heinz", "francisco": "paco pancho", "jose": "pepe",
}

READ = T.StructType(
    [
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("hints", T.ArrayType(T.StringType())),
        T.StructField("form", T.StringType()),
    ]
)


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", consistent(text) or "")
    return "".join(c for c in plain if not unicodedata.combining(c))


def read_name(value: str, person: bool) -> tuple[list[str], list[str], str]:
    """(whole words, hints, legal form): a hint is an initial ``x.``, a shortened word ``abc.`` or, of a person, a pet name ``=abc``."""
    text = fold(value)
    if not person:
        text = re.sub(r"\b([A-Za-z])\.\s?([A-Za-z])\.(?:\s?([A-Za-z])\.)?(?:\s?([A-Za-z])\.)?", lambda m: "".join(x or "" for x in m.groups()), text)  # S.R.L. to SRL
        text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text)
    words, hints, form = [], [], ""
    for token in re.findall(r"[^\W_]+\.?", text):
        bare = token.rstrip(".").lower()
        if person and bare in TITLES or not person and bare in COMPANY:
            continue
        if not person and bare in FORMS and (words or hints):
            form = FORMS[bare]
        elif len(bare) == 1:
            hints.append(bare + ".")
        elif token.endswith(".") and token[:-1] and text.rstrip()[-len(token) :] != token or token.endswith(".") and len(bare) <= 5:
            hints.append(bare + ".")
        else:
            words.append(bare)
    if person:
        pets = {p for names in PET_NAMES.values() for p in names.split()}
        known = [w for w in words if w in pets and w not in PET_NAMES]
        if known and len(words) > 1:
            words.remove(known[0])
            hints.append("=" + known[0])
    return words, hints, form


@F.pandas_udf(READ)
def read_udf(values: pd.Series, persons: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_name(v, bool(p)) for v, p in zip(values, persons)], columns=READ.names)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; where words differ in long stretches, only whether it lacks one letter is worked out."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return start + end + _common_middle(a[start : len(a) - end], b[start : len(b) - end])


def _common_middle(a: str, b: str) -> int:
    """What equal starts and ends leave."""
    if not a or not b:
        return 0
    # Both ends differ here, so texts of one length lack a letter at least; they lack just one if it left one end and another came in at the other.
    if len(a) == len(b) and (a[1:] == b[:-1] or a[:-1] == b[1:]):
        return len(a) - 1
    if max(len(a), len(b)) > 5 * LONG:
        return 0  # two letters are lacking at least, how many does not matter
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(here, row[j])
            before = here
    return row[-1]


def close(a: str, b: str) -> bool:
    """Longest common subsequence over the longer word: all but one letter, and at least four fifths."""
    longer = max(len(a), len(b))
    if abs(len(a) - len(b)) > 1:
        return False
    common = common_length(a, b)
    return common >= longer - 1 and common / longer >= 0.8


def same_full(a: list[str], b: list[str]) -> bool:
    """Whole names: as many words, which agree one to one in some order; at most one of them with a slip."""
    if len(a) != len(b):
        return False
    left, right = list(a), list(b)
    for w in a:
        if w in right:
            left.remove(w)
            right.remove(w)
    if not left:
        return True
    # Two given names that both exist are not slips of one another.
    return len(left) == 1 and close(left[0], right[0]) and not (left[0] in PET_NAMES and right[0] in PET_NAMES)


def hint_fits(hint: str, word: str) -> bool:
    if hint.startswith("="):
        return hint[1:] in PET_NAMES.get(word, "").split() or any(hint[1:] in names.split() and close(name, word) for name, names in PET_NAMES.items())
    return word.startswith(hint[:-1])


def stands_for(words: list[str], hints: list[str], form: str, full: list[str], full_form: str) -> int:
    """How well a short form can stand for a whole name: 0 not at all, 1 with a slip, 2 exactly."""
    if not words or form and full_form and form != full_form:
        return 0
    left, exact = list(full), 2
    for w in words:
        if w in left:
            left.remove(w)
            continue
        found = next((x for x in left if close(w, x)), None)
        if found is None:
            return 0
        exact = 1
        left.remove(found)
    if not hints:
        # A first word alone; the line of business alone names nobody.
        return exact if len(words) == 1 and (words[0] == full[0] or close(words[0], full[0])) else 0
    return exact if left and any(hint_fits(hints[0], x) for x in left) or left and any(hint_fits(h, x) for h in hints[1:] if len(h) > 2 for x in left) else 0


@F.pandas_udf(T.BooleanType())
def same_full_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_full(list(x), list(y)) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.IntegerType())
def stands_for_udf(words: pd.Series, hints: pd.Series, form: pd.Series, full: pd.Series, full_form: pd.Series) -> pd.Series:
    return pd.Series([stands_for(list(w), list(h), f, list(x), g) for w, h, f, x, g in zip(words, hints, form, full, full_form)], dtype="int32")


def meet(left: DataFrame, right: DataFrame, on: str | list[str] | F.Column, how: str = "inner") -> DataFrame:
    """The join by a shuffle, never by a broadcast. Spark takes the size of a table from its compressed files and counts nothing for what
    ``explode`` adds to a row, so what it holds to be below the threshold for a broadcast may fill the driver."""
    return left.join(right.hint("merge"), on, how)


def suffix_keys(names: DataFrame) -> DataFrame:
    """(kind, id, key, whole): the suffixes of every word as ``key``; ``whole`` tells that it is the word itself."""
    word = names.select("kind", "id", F.explode("words").alias("word"))
    size = F.length("word")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), size - LONG + 1), size - LEAST_SUFFIX + 1), lambda i: F.substring(F.col("word"), i, F.lit(LONG)))
    whole = F.when(size > LONG, F.concat(F.lit("#"), F.xxhash64("word").cast("string"))).otherwise(F.col("word"))
    keyed = word.select("kind", "id", whole.alias("whole"), F.explode(F.when(size >= LEAST_SUFFIX, F.array_append(suffixes, whole)).otherwise(F.array(whole))).alias("key"))
    return keyed.select("kind", "id", "key", (F.col("whole") == F.col("key")).alias("whole")).distinct()


def candidate_pairs(names: DataFrame) -> DataFrame:
    """(a, b): pairs of ids, a < b, that share a suffix which is not common, or a common word and the others but for one letter.

    A slip changes one word, so two spellings of a whole name share a whole word,
    the longest suffix. Where that is common, all words but one are a key together
    with that one less a letter, whatever the order of the words.
    """
    keys = suffix_keys(names)
    sizes = keys.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    left = materialise(meet(keys, sizes.where(F.col("n") <= COMMON), ["kind", "key"]).select(F.xxhash64("kind", "key").alias("group"), "id").distinct(), "groups")
    pairs = meet(left.select("group", F.col("id").alias("a")), left.select("group", F.col("id").alias("b")), "group").where("a < b").select("a", "b")
    # Common suffixes are discarded; the whole word keeps every pair that a shorter suffix would give. Words one slip apart are
    # equal once the right letter is taken from one or both, so such a key is shared by no more names than there are letters to put in its place.
    crowded = meet(keys.where("whole"), sizes.where(F.col("n") > COMMON).select("kind", "key"), ["kind", "key"]).select("id").distinct()
    large = meet(crowded, names.select("id", "kind", "words"), "id")
    value = lambda w: F.pmod(F.xxhash64(w), F.lit(_VALUE))
    total = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + value(w))
    word = large.select("id", "kind", total.alias("total"), F.explode(F.array_distinct("words")).alias("word"))
    less = word.select("id", "kind", (F.col("total") - value(F.col("word"))).alias("rest"), F.explode(_less(F.col("word"))).alias("t"))
    less = materialise(less.select("id", F.xxhash64("kind", "rest", "t").alias("group")).distinct(), "groups")
    met = meet(less.select("group", F.col("id").alias("a")), less.select("group", F.col("id").alias("b")), "group").where("a < b").select("a", "b")
    return pairs.unionByName(met).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each node is connected to. Labels spread along edges and are shortened by
    following them; each round is written, so its lineage is cut."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(nodes.select("id", F.col("id").alias("root")), "labels")
    while True:
        heard = meet(both, labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("heard"))
        spread = meet(labels, heard, labels["id"] == heard["a"], "left").select("id", "root", F.least("root", F.coalesce("heard", "root")).alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("root").alias("up"))
        nearer = materialise(meet(spread, up, "new").select("id", F.least("new", "up").alias("root"), (F.least("new", "up") < F.col("root")).alias("moved")), "labels")
        labels = nearer.select("id", "root")
        if nearer.where("moved").isEmpty():
            return labels


def link_spellings(values: DataFrame) -> DataFrame:
    """(value, kind, root): the distinct spellings with the group of each; ``values`` has value and kind (person or organisation).

    Spellings which can stand for no name or for several form groups of their own.
    """
    kept = values.where(F.length(F.trim("value")) > 0).where(F.upper(F.trim("value")) != "N/A")
    distinct = kept.groupBy("kind", "value").agg(F.count("*").alias("n"))
    named = distinct.withColumn("r", read_udf("value", F.col("kind") == "person")).select(F.xxhash64("kind", "value").alias("id"), "kind", "value", "n", "r.*")
    named = materialise(named, "names")
    # A person's whole name may hold a middle initial; an organisation's has two words or more.
    only_middle = F.forall("hints", lambda h: F.length(h) == 2) & (F.col("kind") == "person")
    whole = (F.size("words") >= 2) & ((F.size("hints") == 0) | only_middle)
    full, short = named.where(whole), named.where(~whole & (F.size("words") >= 1))

    pairs = candidate_pairs(full)
    side = full.select("id", "words")
    both = meet(pairs, side.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    both = meet(both, side.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    edges = materialise(both.where(same_full_udf("wa", "wb")).select("a", "b"), "pairs")
    roots = components(full, edges)

    # Short forms: names that share a suffix of one of their words, seen through one usual spelling of each name.
    by_name = meet(full, roots, "id").groupBy("kind", "root", "words").agg(F.sum("n").alias("n"), F.max("form").alias("form"))
    stands = F.struct(F.col("n"), F.col("words"), F.col("form"))
    usual = materialise(by_name.groupBy("kind", "root").agg(F.max(stands).alias("u")).select("kind", F.col("root").alias("id"), "u.words", "u.form"), "usual")
    have = _first_keys(usual).select("kind", "key", "initial", F.col("id").alias("root"))
    ask = _asked_keys(short)
    met = meet(ask, have, ["kind", "key", "initial"]).select("id", "root").distinct()
    with_both = meet(met, short.select("id", "words", "hints", "form"), "id")
    with_both = meet(with_both, usual.select(F.col("id").alias("root"), F.col("words").alias("full"), F.col("form").alias("full_form")), "root")
    fits = materialise(with_both.withColumn("fit", stands_for_udf("words", "hints", "form", "full", "full_form")).where("fit > 0").select("id", "root", "fit"), "fits")
    best = fits.groupBy("id").agg(F.max("fit").alias("fit"))
    only = meet(fits, best, ["id", "fit"]).groupBy("id").agg(F.count("*").alias("n"), F.min("root").alias("root")).where("n = 1").select("id", "root")
    return meet(named.select("id", "kind", "value"), roots.unionByName(only), "id", "left").select("value", "kind", F.coalesce("root", "id").alias("root"))


def _less(text: F.Column) -> F.Column:
    """The text, and the text without each of its letters: texts one slip apart share one of these. Of long texts the sums of their letters'
    values, which texts that share one of these have in common too; texts of just ``LONG`` letters have both."""
    without = F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))), text))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    worth = lambda c: F.pmod(F.xxhash64(c), F.lit(_VALUE))
    total = F.aggregate(letters, F.lit(0).cast("long"), lambda s, c: s + worth(c))
    sums = F.transform(F.array_append(F.transform(F.array_distinct(letters), lambda c: total - worth(c)), total), lambda n: F.concat(F.lit("#"), n.cast("string")))
    return F.when(F.length(text) < LONG, without).when(F.length(text) == LONG, F.concat(without, sums)).otherwise(sums)


def _first_keys(usual: DataFrame) -> DataFrame:
    """Keys of whole names for short forms: one word, less a letter, and the first letter of another, or of none."""
    word = usual.select("kind", "id", F.posexplode("words").alias("at", "word"), "words")
    others = F.array_union(F.transform(F.filter("words", lambda x, i: i != F.col("at")), lambda x: F.substring(x, 1, 1)), F.array(F.lit("")))
    return word.select("kind", "id", F.explode(_less(F.col("word"))).alias("key"), others.alias("o")).select("kind", "id", "key", F.explode("o").alias("initial"))


def _asked_keys(short: DataFrame) -> DataFrame:
    """The same keys of short forms. Pet names say nothing of the first letter."""
    first = F.when((F.size("hints") == 0) | F.exists("hints", lambda h: h.startswith("=")), F.array(F.lit(""))).otherwise(F.transform("hints", lambda h: F.substring(h, 1, 1)))
    word = short.select("kind", "id", F.explode("words").alias("word"), first.alias("o"))
    return word.select("kind", "id", F.explode(_less(F.col("word"))).alias("key"), "o").select("kind", "id", "key", F.explode("o").alias("initial"))


def all_pairs(groups: DataFrame) -> DataFrame:
    """(value_a, value_b): the pairs of distinct values of each group, value_a < value_b in code point order."""
    left = groups.select("root", F.col("value").alias("value_a"))
    right = groups.select("root", F.col("value").alias("value_b"))
    return meet(left, right, "root").where("value_a < value_b").select("value_a", "value_b").distinct()
