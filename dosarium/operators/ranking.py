"""Numbering rows in order without gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds rank (long, from 1) in ``order`` within ``keys``. Rows are range partitioned by key and order, numbered
    within each partition, and moved up by what earlier partitions hold of the key: a hot key spans many tasks."""
    placed = materialise(rows.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()), "ranked")
    local = Window.partitionBy("__p", *keys).orderBy(*order)
    numbered = placed.withColumn("__r", F.row_number().over(local).cast("long"))
    sizes = placed.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    moved = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    on = None
    moved = moved.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), "__o")
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    here = F.col("__p") == F.col("__q")
    out = numbered.join(moved, here if on is None else here & on)
    return out.withColumn("rank", F.col("__r") + F.col("__o")).select(*rows.columns, "rank")
