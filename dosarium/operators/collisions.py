"""Targets that do not collide: ``name``, then ``name_1``, ``name_2`` and so on, whichever is free first.

The rule is greedy and depends on the order, yet little of it is sequential. Of
all that ask for one name the first may get it; the others get its numbers in
order, without those that are taken. A number of a name can be taken only by a
file that lies there or by one that asks for just that numbered name before the
numbers have come so far. So the requests are ranked within their name, spread
over tasks however many they are, and only the distinct numbered names of a
folder that belong together are looked at one after the other.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import materialise
from .ranking import ranked

#: A numbered name: the stem it is a number of, and the number as the rule writes it.
_CHILD = r"(?s)^(.*)_([1-9][0-9]{0,17})$"
_SETTLED = "folder string, name string, direct boolean, taken array<long>"


def _numbered(stem: Column, suffix: Column, n: Column) -> Column:
    return F.when(n == 0, F.concat(stem, suffix)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix))


def _family(names: DataFrame) -> DataFrame:
    """Adds parent and number: the name that this one is a number of, null for none."""
    suffix, stem = paths.suffix(F.col("name")), paths.stem(F.col("name"))
    parent = F.concat(F.regexp_extract(stem, _CHILD, 1), suffix)
    number = F.regexp_extract(stem, _CHILD, 2)
    back = F.concat(paths.stem(parent), F.lit("_"), number, paths.suffix(parent))
    is_child = stem.rlike(_CHILD) & (back == F.col("name"))
    return names.withColumns({"parent": F.when(is_child, parent), "number": F.when(is_child, number.cast("long"))})


def plan_targets(moves: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(path, folder, name, target): ``moves`` is (path, folder, name), taken in order of path; ``existing`` is (folder, name).

    Null names and folders are left out. Paths must be unique. One task holds the distinct names of one folder that differ in
    nothing but numbers, never the requests for them.
    """
    spark = moves.sparkSession
    asked = moves.select("path", "folder", "name").where("folder is not null and name is not null")
    there = (existing if existing is not None else spark.createDataFrame([], "folder string, name string")).where("folder is not null and name is not null").select("folder", "name").distinct()
    requests = ranked(asked, ["folder", "name"], ["path"])

    counts = asked.groupBy("folder", "name").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    held = there.withColumn("there", F.lit(True))
    every = counts.join(held, ["folder", "name"], "full").withColumns({"n": F.coalesce("n", F.lit(0)), "there": F.coalesce("there", F.lit(False)), "base": F.regexp_replace("name", r"_[0-9]+", "")})
    every = materialise(_family(every), "names")
    # Only where somebody asks for a name that another one is a number of, is there anything to look at.
    parents = counts.select("folder", F.col("name").alias("parent"))
    together = every.where("parent is not null").join(parents, ["folder", "parent"], "left_semi").select("folder", "base").distinct()
    names = materialise(every.join(together, ["folder", "base"], "left_semi"), "together")

    # How many had asked for the parent before the numbered name was asked for first.
    marks = names.where("n > 0 and parent is not null").select("folder", F.col("parent").alias("name"), F.col("first").alias("path"), F.col("name").alias("child"))
    marks = materialise(marks.join(counts.select("folder", "name"), ["folder", "name"], "left_semi"), "marks")
    both = asked.join(marks.select("folder", "name").distinct(), ["folder", "name"], "left_semi").withColumn("child", F.lit(None).cast("string")).unionByName(marks)
    among = ranked(both, ["folder", "name"], ["path"]).where("child is not null").select("folder", "child", F.col("rank").alias("of_all"))
    alone = ranked(marks, ["folder", "name"], ["path"]).select("folder", "child", F.col("rank").alias("of_marks"))
    before = among.join(alone, ["folder", "child"]).select("folder", F.col("child").alias("name"), (F.col("of_all") - F.col("of_marks")).alias("before"))

    settled = names.join(before, ["folder", "name"], "left").groupBy("folder", "base").applyInPandas(_settle, _SETTLED)
    known = requests.join(settled, ["folder", "name"], "left").join(held, ["folder", "name"], "left")
    first_gets_it = F.coalesce("direct", ~F.coalesce("there", F.lit(False)))
    turn = F.col("rank") - first_gets_it.cast("long")  # 0 for the one that gets the name itself
    skipped = F.size(F.filter(F.coalesce("taken", F.array().cast("array<long>")), lambda t, i: t - i <= turn))
    number = F.when(turn == 0, F.lit(0)).otherwise(turn + skipped)
    return known.select("path", "folder", "name", _numbered(paths.stem(F.col("name")), paths.suffix(F.col("name")), number).alias("target"))


def _reach(taken: list[int], count: int) -> int:
    """The last of the first ``count`` numbers that are not taken."""
    low, high = 0, len(taken)
    while low < high:
        middle = (low + high) // 2
        if taken[middle] - middle <= count:
            low = middle + 1
        else:
            high = middle
    return count + low


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    """Which names their first request gets, and which numbers of each are taken, in order; parents before children."""
    rows = {r.name: r for r in group[["name", "n", "there", "parent", "number", "first", "before"]].itertuples(index=False, name="Row")}
    children: dict[str, list[str]] = defaultdict(list)
    roots = []
    for name, row in rows.items():
        if isinstance(row.parent, str) and row.parent in rows and rows[row.parent].n > 0:
            children[row.parent].append(name)
        else:
            roots.append(name)
    direct = {name: not rows[name].there for name in roots}
    taken: dict[str, list[int]] = {}
    waiting = roots
    while waiting:
        name = waiting.pop()
        own = children.get(name, [])
        held = sorted(int(rows[c].number) for c in own if rows[c].there)
        for c in sorted((c for c in own if not rows[c].there), key=lambda c: rows[c].first):
            # Those who had asked for the name before, less the one that got it.
            given = int(rows[c].before) - (1 if direct[name] and rows[c].before > 0 else 0)
            number = int(rows[c].number)
            direct[c] = number > _reach(held, given)
            if direct[c]:
                bisect.insort(held, number)
        for c in own:
            if rows[c].there:
                direct[c] = False
        taken[name] = held
        waiting += own
    folder = group["folder"].iloc[0]
    out = [(folder, name, direct[name], taken[name]) for name, row in rows.items() if row.n > 0]
    return pd.DataFrame(out, columns=["folder", "name", "direct", "taken"])
