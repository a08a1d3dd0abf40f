"""Relational steps of a scan: what is new, what it is, which rule holds for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text

# Fixed value: what stands for a key that nobody has set.
PLACEHOLDER_KEY = "your_api_key_here"
# Naming conventions with a meaning of their own.
DESCRIPTIVE, ORIGINAL = "descriptive_name_based_on_content", "{original_filename}"


def inventory(files: DataFrame, path: str) -> DataFrame:
    """(path, name, suffix, kind) of each distinct path; null paths are no files."""
    c = F.col("path")
    return files.select(F.col(path).alias("path")).where(c.isNotNull()).distinct().select(c, paths.name(c).alias("name"), paths.suffix(c).alias("suffix"), paths.kind(c).alias("kind"))


def visible_files(files: DataFrame) -> DataFrame:
    return files.where(paths.visible(F.col("path")))


def new_files(files: DataFrame, reviewed: DataFrame, path: str = "original_path") -> DataFrame:
    """Files whose path, as it is written, is not under review. Put this before any costly step: Spark does not
    move an anti-join below a UDF by itself."""
    return files.join(reviewed.select(F.col(path).alias("path")), "path", "left_anti")


def skipped_files(files: DataFrame, reviewed: DataFrame, path: str = "original_path") -> DataFrame:
    return files.join(reviewed.select(F.col(path).alias("path")), "path", "left_semi")


def apply_rule(files: DataFrame, rule: DataFrame) -> DataFrame:
    """Every file beside one preset. More than one row of ``rule`` is an error, none gives no rows."""
    rows = rule.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("one preset at a time")
    return files.crossJoin(F.broadcast(rule)) if rows else files.limit(0).crossJoin(rule)


def bypasses(category: Column) -> Column:
    """Whether a rule takes every file without asking the model."""
    return F.lower(text.strip(category)).isin(*paths.EVERYTHING)


def naming_mode(convention: Column) -> Column:
    plain = text.strip(convention)
    return F.when(plain.isin(DESCRIPTIVE, ""), "descriptive").when(plain == ORIGINAL, "original").when(convention.isNotNull(), "template")


def bypass_decision(files: DataFrame) -> DataFrame:
    """Adds suggested_name and suggested_folder by the rule alone; needs name, suffix, content, summary_name, naming_convention, folder_structure.

    A descriptive rule names an image by its caption, and other files as the summary suggests, with the file's suffix; without
    either, and under other conventions, the original name is kept. Names are sanitised.
    """
    wanted, suffix = F.col("summary_name"), F.col("suffix")
    named = F.when(wanted.isNotNull() & (wanted != ""), paths.append_suffix(wanted, suffix)).otherwise(F.col("name"))
    caption = F.coalesce(F.col("content").contains(text.MARKER), F.lit(False))
    described = F.when(caption, text.descriptive_name(F.col("content"), F.col("name"), suffix)).otherwise(named)
    chosen = F.when(naming_mode(F.col("naming_convention")) == "descriptive", described).otherwise(F.col("name"))
    folder = paths.folder_or_default(F.col("folder_structure"), text.strip(F.col("folder_structure")))
    return files.withColumns({"suggested_name": text.sanitise(chosen), "suggested_folder": folder, "status": F.lit("move")})


def route(decisions: DataFrame) -> DataFrame:
    """Adds outcome: move, quarantine, or error where a needed field is null or the status is none of the two.

    A file under review needs a name; a move needs a name and a folder. The folder of a reviewed file is always the
    review folder, whatever was suggested.
    """
    name, folder, status = F.col("suggested_name"), F.col("suggested_folder"), F.col("status")
    outcome = F.when(~F.coalesce(status.isin("move", "quarantine"), F.lit(False)) | name.isNull(), "error").when((status == "move") & folder.isNull(), "error").otherwise(status)
    return decisions.withColumn("outcome", outcome).withColumn("target_folder", F.when(F.col("outcome") == "quarantine", paths.QUARANTINE_FOLDER).when(F.col("outcome") == "move", folder))


def scan_summary(files: DataFrame, reviewed: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: total, skipped, added (moved or put under review), failed."""
    seen = files.agg(F.count("*").alias("total"))
    skipped = skipped_files(files, reviewed).agg(F.count("*").alias("skipped"))
    done = outcomes.agg(F.count_if(F.col("outcome") != "error").alias("added"), F.count_if(F.col("outcome") == "error").alias("failed"))
    return seen.crossJoin(skipped).crossJoin(done)  # one row each


def usable_key(key: Column) -> Column:
    """Whether a key is set and is not the placeholder."""
    return F.coalesce(~text.strip(key).isin("", PLACEHOLDER_KEY), F.lit(False))


def provider(key: Column) -> Column:
    """Which kind of model answers: the cloud's where there is a key, else the local one."""
    return F.when(usable_key(key), "cloud").otherwise("local")


def valid_approval(name: Column, folder: Column) -> Column:
    return F.coalesce((text.strip(name) != "") & (text.strip(folder) != ""), F.lit(False))


def valid_rule(name: Column, query: Column, naming: Column) -> Column:
    return F.coalesce((text.strip(name) != "") & (text.strip(query) != "") & (text.strip(naming) != ""), F.lit(False))
