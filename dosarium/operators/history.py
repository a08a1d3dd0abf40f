"""The bounded log of moves, and moving files for real.

Plans are DataFrames; files are touched on the driver only, after the plan is
final, because a task may run more than once.
"""

from __future__ import annotations

import shutil
from collections import deque
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_ACTIONS = 50


def newest(log: DataFrame, keys: list[str], order: list[str], n: int = MOST_ACTIONS) -> DataFrame:
    """The n newest rows of each key; Spark limits each group before the shuffle. Null keys form one group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def last_action(log: DataFrame, order: list[str]) -> DataFrame:
    """The one row that an undo takes next."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(1)


def in_order(log: DataFrame, keys: list[str], order: list[str], n: int = MOST_ACTIONS) -> DataFrame:
    """The n newest rows of each key with ordinal, from 1, oldest first; no key has more than n rows here."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return newest(log, keys, order, n).withColumn("ordinal", rank)


def undo_last(log: DataFrame, keys: list[str], order: list[str], there: str) -> DataFrame:
    """(keys, order, undone, left) of each key's newest row, which goes whether or not its file is there (boolean column ``there``)."""
    kept = in_order(log, keys, order)
    last = F.max(F.struct("ordinal", *order, F.coalesce(there, F.lit(False)).alias("__there"))).alias("l")
    return kept.groupBy(*keys).agg(last).select(*keys, *[F.col(f"l.{c}").alias(c) for c in order], F.col("l.__there").alias("undone"), (F.col("l.ordinal") - 1).alias("left"))


def undo_at(log: DataFrame, asked: DataFrame, keys: list[str], order: list[str], there: str) -> DataFrame:
    """(keys, index, undone, left) of each row of ``asked`` (keys, index): the row at that place, counted from 0 from the oldest, goes only
    if its file is there; places outside the list are none."""
    kept = in_order(log, keys, order).select(*keys, (F.col("ordinal") - 1).alias("index"), F.coalesce(there, F.lit(False)).alias("__there"))
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("__n"))
    found = asked.select(*keys, "index").join(sizes, keys, "left").join(kept, [*keys, "index"], "left")
    undone = F.coalesce("__there", F.lit(False))
    return found.select(*keys, "index", undone.alias("undone"), (F.coalesce("__n", F.lit(0)) - undone.cast("int")).alias("left"))


def with_sources(moves: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Adds found: whether the file to be moved is there."""
    there = sources.select(F.col("path").alias("__path")).distinct().withColumn("__found", F.lit(True))
    return moves.join(there, moves[path] == F.col("__path"), "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__path", "__found")


class MoveLog:
    """At most ``most`` moves, oldest out first."""

    def __init__(self, most: int = MOST_ACTIONS):
        self.actions: deque[tuple[str, str]] = deque(maxlen=most)

    def record_action(self, old: str | Path, new: str | Path) -> None:
        self.actions.append((str(old), str(new)))

    def get_history(self) -> list[dict[str, str]]:
        return [{"old_path": a, "new_path": b} for a, b in self.actions]

    def history_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, a, b) for i, (a, b) in enumerate(self.actions)]
        return spark.createDataFrame(rows, "seq long, old_path string, new_path string").orderBy("seq")

    @staticmethod
    def _back(old: str, new: str) -> bool:
        if not Path(new).exists():
            return False
        try:
            Path(old).parent.mkdir(parents=True, exist_ok=True)
            shutil.move(new, old)
        except OSError:
            return False
        return True

    def undo_last_action(self) -> bool:
        """The entry is gone even if its file is not there any more."""
        return bool(self.actions) and self._back(*self.actions.pop())

    def undo_action(self, index: int) -> bool:
        """The entry goes only if the file came back; negative positions are none."""
        if not 0 <= index < len(self.actions) or not self._back(*self.actions[index]):
            return False
        del self.actions[index]
        return True


def move_and_rename(source: str | Path, folder: str | Path, name: str, log: MoveLog | None = None) -> Path:
    """Move one file to a free name in the folder."""
    source, folder = Path(source), Path(folder)
    if not source.is_file():
        raise FileNotFoundError(source)
    folder.mkdir(parents=True, exist_ok=True)
    wanted = folder / name
    target, n = wanted, 1
    while target.exists():
        target, n = wanted.with_name(f"{wanted.stem}_{n}{wanted.suffix}"), n + 1
    shutil.move(str(source), str(target))
    if log is not None:
        log.record_action(source, target)
    return target


def apply_moves(plan: Iterable, destination: str | Path, log: MoveLog) -> list[tuple[str, str | None, str | None]]:
    """Carry out (path, folder, name) rows of a final plan, one by one. Moves out of the destination are refused.

    Returns (path, target, error) of each; an error stays with its row. Give it ``plan.toLocalIterator()``, so that
    the plan is never held as a whole.
    """
    done = []
    root = Path(destination).resolve()
    for row in plan:
        path, folder, name = row["path"], row["folder"], row["name"]
        try:
            where = (root / (folder or "")).resolve()
            if root != where and root not in where.parents or Path(name).name != name:
                raise PermissionError(f"outside {root}")
            done.append((path, str(move_and_rename(path, where, name, log)), None))
        except OSError as e:
            done.append((path, None, f"{type(e).__name__}: {e}"))
    return done
