"""The scan as one plan: list, drop what is under review, read, extract, decide, route, name without collisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text, validate
from ..operators import collisions, scan
from ..operators.history import MoveLog, apply_moves
from ..operators.stores import QuarantineStore
from ..session import materialise
from ..sources import files as sources

EXTRACT_PROMPT = "Summarise the document and list its entities as JSON.\n{content}"
COMPILE_PROMPT = "Translate the instruction into a rule (category, folder_structure, naming_convention) as JSON.\n{instruction}"
DECIDE_PROMPT = "Category: {category}\nFolder: {folder}\nNaming: {naming}\nFile: {name}\nSummary: {summary}\nAnswer move or quarantine as JSON."


def stub_model(prompt: str) -> str:
    """The deterministic stand-in for a language model: everything goes under review under its own name."""
    if prompt.startswith("Summarise"):
        return '{"document_type": "unknown", "summary": ""}'
    name = next((line[6:] for line in prompt.splitlines() if line.startswith("File: ")), "file")
    import json

    return json.dumps({"status": "quarantine", "suggested_name": name, "suggested_folder": paths.QUARANTINE_FOLDER})


def plan_scan(files: DataFrame, reviewed: DataFrame, rule: DataFrame, extractor: Callable[[str], str] = stub_model, decider: Callable[[str], str] = stub_model, readers: dict | None = None, caption: Callable[[str], str] = sources.no_caption, existing: DataFrame | None = None) -> DataFrame:
    """(path, name, outcome, target_folder, target, reason, error) of each new file.

    ``rule`` is the chosen preset (category, folder_structure, naming_convention). A missing one is an error. The
    anti-join stands before any reader or model. A rule for everything asks no model for a decision: its files are a
    branch of their own. Model answers are written once, so that a retried task does not ask again. ``caption`` describes an image;
    ``existing`` (folder, name) are the files at the destination, whose names are not given again.
    """
    if rule.isEmpty():
        raise LookupError("no such preset")
    new = scan.new_files(files, reviewed)
    read = sources.with_content(new, readers, caption)
    extracted = read.withColumn("x", validate.ask(extractor, text.prompt_of(EXTRACT_PROMPT, content=F.col("content")), validate.EXTRACTION))
    extracted = materialise(extracted, "extracted")
    summary = F.when(F.col("x.error").isNull(), text.technical_summary(F.col("x.summary"))).otherwise(F.concat(F.lit("Eroare procesare text: "), "x.error"))
    ruled = scan.apply_rule(extracted.withColumns({"summary": summary, "summary_name": F.col("x.suggested_filename")}), rule)
    everything = scan.bypasses(F.col("category"))
    bypassed = scan.bypass_decision(ruled.where(everything)).withColumn("error", F.lit(None).cast("string"))
    prompt = text.prompt_of(DECIDE_PROMPT, category=F.col("category"), folder=F.col("folder_structure"), naming=F.col("naming_convention"), name=F.col("name"), summary=F.col("summary"))
    asked = ruled.where(~everything).withColumn("d", validate.ask(decider, prompt, validate.DECISION))
    asked = asked.withColumns({"status": F.col("d.status"), "suggested_name": F.col("d.suggested_name"), "suggested_folder": F.col("d.suggested_folder"), "error": F.col("d.error")}).drop("d")
    decided = materialise(scan.route(bypassed.select(*asked.columns).unionByName(asked)), "decided")
    moves = decided.where("outcome = 'move'").select("path", F.col("target_folder").alias("folder"), F.col("suggested_name").alias("name"))
    targets = collisions.plan_targets(moves, existing).select(F.col("path").alias("__path"), "target")
    out = decided.join(targets, F.col("path") == F.col("__path"), "left").drop("__path")
    reason = F.when(F.col("outcome") == "quarantine", text.reason_text(F.col("status"), F.coalesce("summary", F.lit(""))))
    return out.select("path", "name", "outcome", "target_folder", F.coalesce("target", "suggested_name").alias("target"), reason.alias("reason"), "error")


def review_rows(plan: DataFrame) -> DataFrame:
    """What a plan puts under review, as ``QuarantineStore.append_all`` takes it."""
    rows = plan.where("outcome = 'quarantine'")
    return rows.select(F.col("path").alias("order"), F.col("path").alias("original_path"), F.col("target").alias("ai_proposed_name"), F.col("target_folder").alias("ai_proposed_folder"), "reason")


def carry_out(plan: DataFrame, store: QuarantineStore, destination: str, log: MoveLog) -> list[tuple[str, str | None, str | None]]:
    """Move what is to be moved, one by one, and put the rest under review. The plan must lie in a table."""
    moves = plan.where("outcome = 'move'").select("path", F.col("target_folder").alias("folder"), F.col("target").alias("name")).orderBy("path")
    done = apply_moves(moves.toLocalIterator(), destination, log)
    store.append_all(review_rows(plan))
    return done


def compile_rules(presets: DataFrame, compiler: Callable[[str], str], instruction: str = "query") -> DataFrame:
    """Adds rule (category, folder_structure, naming_convention, error): what the model makes of each preset's instruction. Asked once, written."""
    asked = presets.withColumn("rule", validate.ask(compiler, text.prompt_of(COMPILE_PROMPT, instruction=F.col(instruction)), validate.RULE))
    return materialise(asked, "rules")
