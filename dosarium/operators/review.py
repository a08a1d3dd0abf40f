"""Deciding on what is under review: approving moves a file and ends its row, rejecting ends the row only.

The plans are DataFrames over the whole table; ``approve`` and ``reject`` carry
out one decision against a store, on the driver.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .history import MoveLog, move_and_rename
from .stores import QuarantineStore


def approvals(reviewed: DataFrame, edits: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, path, name, folder, outcome, removed) of each edit of a row under review.

    ``reviewed`` is (id, original_path), ``edits`` (id, name, folder) once an id, ``sources`` (path) the files there are.
    Without a name or a folder nothing happens (incomplete); the row of a file that is gone is removed (vanished).
    Edits of unknown ids are left out. The other columns of the inputs are not read.
    """
    asked = reviewed.select("id", F.col("original_path").alias("path")).join(edits.select("id", text.strip(F.col("name")).alias("name"), text.strip(F.col("folder")).alias("folder")), "id")
    there = sources.select("path").where("path is not null").distinct().withColumn("__there", F.lit(True))
    known = asked.join(there, "path", "left")
    complete = F.coalesce((F.col("name") != "") & (F.col("folder") != ""), F.lit(False))
    outcome = F.when(~complete, "incomplete").when(F.col("__there").isNull(), "vanished").otherwise("move")
    return known.select("id", "path", "name", "folder", outcome.alias("outcome"), complete.alias("removed"))


def remaining(reviewed: DataFrame, removed: DataFrame) -> DataFrame:
    """What stays under review once the ids of ``removed`` are rejected or approved."""
    return reviewed.join(removed.select("id").distinct(), "id", "left_anti")


def approve(store: QuarantineStore, key: int, name: str, folder: str, log: MoveLog | None = None) -> str:
    """moved, vanished (the row goes too), incomplete, unknown, or the error because of which the row stays."""
    row = store.get_by_id(key)
    if row is None:
        return "unknown"
    if not name.strip() or not folder.strip():
        return "incomplete"
    try:
        move_and_rename(row["original_path"], Path(folder.strip()), name.strip(), log)
    except FileNotFoundError:
        store.remove(key)
        return "vanished"
    except OSError as e:
        return f"{type(e).__name__}: {e}"
    store.remove(key)
    return "moved"


def reject(store: QuarantineStore, key: int) -> bool:
    """The file stays where it is, so the next scan takes it up again."""
    return store.remove(key)
