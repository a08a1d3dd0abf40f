"""Session factory, table loading and scratch tables.

Scratch tables cut lineage: they are written below the folder that the session
names in ``spark.checkpoint.dir``, so they outlive a lost executor.
"""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings that the results depend on or that let Spark re-plan at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def create_session(app: str = "dosarium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "dosarium-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dosarium/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    schema = T.StructType([f for f in df.schema if f.name not in (partition_by or [])] + [df.schema[c] for c in partition_by or []])
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over as many tasks as the session shuffles to: for few rows that cost much each, which would else be put into one task.
    A hash of the columns, as Spark drops a repartitioning by columns that the rows are partitioned by already."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*columns))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, for clusters that do not have it on their path."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_dosarium_shipped", False):
        return
    here = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp()) / "dosarium.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._dosarium_shipped = True


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/dosarium/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
