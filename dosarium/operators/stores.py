"""Keyed tables as append-only logs, folded into their current state.

A log row is (seq, op, key, fields). ``clear`` ends everything before it; of a
key's rows the last ``add`` or ``remove`` says whether it lives; a field has its
last value that is not null since the last ``add``. The fold is two
aggregations, both combined before the shuffle, so a key that holds a third of
the log is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(log: DataFrame, key: str, fields: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """(key, fields, added_seq): the keys that live. Rows of a null key other than ``clear`` are ignored; of rows with
    equal seq the greatest value counts. An empty log gives no rows."""
    cleared = log.where(F.col(op) == "clear").agg(F.max(seq).alias("__cleared"))  # one row
    rows = log.where(F.col(key).isNotNull() & (F.col(op) != "clear")).crossJoin(F.broadcast(cleared)).where(F.col("__cleared").isNull() | (F.col(seq) > F.col("__cleared"))).drop("__cleared")
    last = rows.groupBy(key).agg(F.max(F.when(F.col(op) == "add", F.col(seq))).alias("added_seq"), F.max(F.when(F.col(op) == "remove", F.col(seq))).alias("__removed"))
    living = last.where("added_seq is not null and (__removed is null or __removed < added_seq)").select(key, "added_seq")
    kept = rows.join(living, key).where((F.col(seq) >= F.col("added_seq")) & F.col(op).isin("add", "update"))
    values = [F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    return kept.groupBy(key).agg(*values, F.max("added_seq").alias("added_seq"))


def numbered(rows: DataFrame, order: list[str], last: int) -> DataFrame:
    """Adds id: the numbers after ``last``, in ``order``."""
    from .ranking import ranked

    return ranked(rows, [], order).withColumn("id", F.col("rank") + F.lit(last)).drop("rank")


def lookup(current: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Every row of ``asked`` beside the row of its key, with found; texts are compared as they are."""
    held = current.withColumn("found", F.lit(True)).withColumnRenamed(key, "__key")
    return asked.join(held, asked[key] == F.col("__key"), "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("__key")


def saved(saves: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The presets after all ``saves``, which have unique ``order``: saving a name again is a delete and an insert, so its id is the last save's number."""
    return latest_by(numbered(saves, order, 0), name, ["id"])


def seeded(rules: DataFrame, default: tuple) -> DataFrame:
    """The default preset where there is none at all."""
    empty = rules.agg((F.count("*") == 0).alias("__empty"))  # one row
    row = rules.sparkSession.createDataFrame([default], rules.schema).crossJoin(empty).where("__empty").drop("__empty")
    return rules.unionByName(row)


def newest_first(rules: DataFrame) -> DataFrame:
    """Presets in the order in which they are listed."""
    return rules.orderBy(F.desc("created_at"), F.desc("id"))


class LogStore:
    """One writer; each call appends one file, so what was written is never changed. ``compact`` folds the log when it has many."""

    fields: dict[str, T.DataType] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("id", T.LongType()), *[T.StructField(n, t) for n, t in self.fields.items()]])
        self._marks: tuple[int, int] | None = None
        self._create()

    def _create(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def current(self) -> DataFrame:
        return fold(self.log(), "id", list(self.fields)).select("id", *self.fields)

    def get_all(self) -> DataFrame:
        return self.current().orderBy("id")

    def get_by_id(self, key: int) -> dict | None:
        row = self.current().where(F.col("id") == key).first()
        return row.asDict() if row else None

    def _next(self) -> tuple[int, int]:
        """The next seq and the next id, from high-water marks over the whole log, read once: ids are never used again."""
        if self._marks is None:
            row = self.log().agg(F.max("seq").alias("seq"), F.max(F.when(F.col("op").isin("add", "mark"), F.col("id"))).alias("id")).first()
            self._marks = row["seq"] or 0, row["id"] or 0
        return self._marks[0] + 1, self._marks[1] + 1

    def _append(self, op: str, key: int | None, values: dict) -> None:
        seq, _ = self._next()
        self.spark.createDataFrame([(seq, op, key, *[values.get(f) for f in self.fields])], self.schema).coalesce(1).write.mode("append").parquet(self.path)
        self._marks = seq, max(self._marks[1], key or 0) if op == "add" else self._marks[1]

    def append_all(self, rows: DataFrame) -> None:
        """Add many rows at once; ids follow the order of ``rows``' column ``order``, which must be unique."""
        seq, key = self._next()
        added = numbered(rows, ["order"], key - 1)
        added.select((F.col("id") - key + seq).alias("seq"), F.lit("add").alias("op"), "id", *self.fields).write.mode("append").parquet(self.path)
        self._marks = None

    def compact(self) -> None:
        """Write the living rows and the high-water marks as one log in place of the old files, which go once the new ones are there."""
        seq, key = self._next()
        old = [f.getPath() for f in self._listed()]
        living = self.current()
        marks = self.spark.createDataFrame([(seq, "clear", None, *[None for _ in self.fields]), (seq, "mark", key - 1, *[None for _ in self.fields])], self.schema)
        kept = living.select(F.lit(seq + 1).cast("long").alias("seq"), F.lit("add").alias("op"), "id", *self.fields)
        # Until the old files are gone their rows lie before the clear, so a reader sees the same table at any time.
        marks.unionByName(kept).write.mode("append").parquet(self.path)
        files = old[0].getFileSystem(self.spark._jsc.hadoopConfiguration()) if old else None
        for path in old:
            files.delete(path, False)
        self._marks = None

    def _listed(self) -> list:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return [f for f in where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where) if f.getPath().getName().endswith(".parquet")]


class QuarantineStore(LogStore):
    fields = {"original_path": T.StringType(), "ai_proposed_name": T.StringType(), "ai_proposed_folder": T.StringType(), "reason": T.StringType()}

    def add(self, original_path: str, ai_proposed_name: str, ai_proposed_folder: str, reason: str | None = "") -> int:
        if None in (original_path, ai_proposed_name, ai_proposed_folder):
            raise ValueError("path, name and folder are needed")
        _, key = self._next()
        self._append("add", key, {"original_path": original_path, "ai_proposed_name": ai_proposed_name, "ai_proposed_folder": ai_proposed_folder, "reason": reason})
        return key

    def update(self, key: int, **changes: str | None) -> bool:
        """Fields that are not None change, the empty text being a value. False without changes or for an unknown id."""
        changes = {k: v for k, v in changes.items() if v is not None and k in self.fields}
        if not changes or self.get_by_id(key) is None:
            return False
        self._append("update", key, changes)
        return True

    def remove(self, key: int) -> bool:
        if self.get_by_id(key) is None:
            return False
        self._append("remove", key, {})
        return True

    def clear_all(self) -> int:
        n = self.current().count()
        if n:
            self._append("clear", None, {})
        return n


class RuleStore(LogStore):
    """Presets by name. Saving a name again is a delete and an insert: id and time are new."""

    fields = {"name": T.StringType(), "query": T.StringType(), "folder_template": T.StringType(), "naming_template": T.StringType(), "created_at": T.TimestampType()}
    # The preset that an empty table is given.
    DEFAULT = ("Smart Auto-Sort (Default)", "Toate fișierele", "", "[An]_[Emitent]_[SubiectAI]")

    def seed(self) -> None:
        if self.current().isEmpty():
            self.save_rule(*self.DEFAULT)

    def save_rule(self, name: str, query: str, folder_template: str, naming_template: str) -> int:
        from datetime import datetime, timezone

        _, key = self._next()
        old = self.current().where(F.col("name") == name).select("id").collect()  # at most one
        for row in old:
            self._append("remove", row["id"], {})
        now = datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None)
        self._append("add", key, {"name": name, "query": query, "folder_template": folder_template, "naming_template": naming_template, "created_at": now})
        return key

    def get_all_rules(self) -> DataFrame:
        return newest_first(self.current())

    def get_rule_by_name(self, name: str) -> dict | None:
        row = self.current().where(F.col("name") == name).first()
        return row.asDict() if row else None

    def delete_rule(self, name: str) -> bool:
        """True even where there was no such preset."""
        for row in self.current().where(F.col("name") == name).select("id").collect():  # at most one
            self._append("remove", row["id"], {})
        return True


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, combined before the shuffle; ties in ``order`` go to the greatest of the other columns."""
    others = [c for c in rows.columns if c != key and c not in order]
    newest = F.max(F.struct(*order, *others)).alias("__r")
    return rows.groupBy(key).agg(newest).select(key, *[F.col(f"__r.{c}").alias(c) for c in [*order, *others]])
