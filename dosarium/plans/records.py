"""Further queries of the routing engine with their SQL: readers by kind, answers of models, stores, review, undo, collisions, the whole scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text, validate
from ..operators import collisions, history, review, scan, stores
from ..session import table
from . import scan as scan_plans
from .catalogue import INVENTORY_SQL, _deliveries, _files, _kind_sql

ORDER = ["ts", "event_id"]

# Readers by kind


def unknown_type(spark, d):
    return _files(spark, d).where("kind = 'unknown'").select("path", text.unknown_type_text(F.lower("suffix")).alias("content"))


def image_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.image_text(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("content"))


def image_payload(spark, d):
    images = _files(spark, d).where("kind = 'image'")
    return images.select("path", paths.data_url(F.col("path"), F.col("path").cast("binary")).alias("url"))


def plain_text(spark, d):
    from ..sources.files import decode_text

    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    return table(spark, d, "documents").where("text is not null").select("doc_id", decode_text(broken).alias("content"))


def docx_paragraphs(spark, d):
    return table(spark, d, "extract_inputs").select("input_id", text.join_paragraphs(F.split("document_text", "\n")).alias("content"))


def first_pages(spark, d):
    return table(spark, d, "extract_inputs").select("input_id", text.first_pages(F.split("document_text", "\n\n"), 2).alias("content"))


def _caption(path: str) -> str:
    """Stands for a vision model: refuses, fails or describes by the path's ending."""
    if path.lower().endswith(".bmp"):
        raise ValueError("no such model")
    return "" if path.lower().endswith(".tiff") else "Un dosar"


def _failing(path: str) -> str:
    raise OSError("unreadable")


def content_dispatch(spark, d):
    """Every file's content by the reader of its kind; a reader's failure is a text."""
    from ..sources.files import with_content

    return with_content(_files(spark, d), {"pdf": lambda p: f"pdf {p}", "docx": _failing, "image": lambda p: "", "text": _failing}, _caption).select("path", "content")


# Answers of models


def summary_length(spark, d):
    return table(spark, d, "documents").select("doc_id", validate.summary_fits(F.col("text")).alias("valid"))


def rate_limits(spark, d):
    return table(spark, d, "quarantine").select("id", validate.rate_limited(F.concat_ws(" ", "original_path", "reason")).alias("again"))


def key_usable(spark, d):
    keys = table(spark, d, "quarantine").select("id", F.when(F.col("reason") == "", F.lit(" your_api_key_here\n")).otherwise(F.col("reason")).alias("key"))
    return keys.select("id", scan.usable_key(F.col("key")).alias("usable"), scan.provider(F.col("key")).alias("provider"))


def payload_flatten(spark, d):
    parts = F.filter(F.array("document_type", "summary", "suggested_filename"), lambda x: x.isNotNull())
    return table(spark, d, "extractions").select("extraction_id", text.flatten_payload(F.transform(parts, lambda x: F.struct(x.alias("text")))).alias("said")).distinct()


#: Broken and unusual answers with a type {t} given as a JSON text, and whether each is valid.
ANSWERS = {
    "plain": ('{"document_type": {t}}', True),
    "fenced": ('```json\n{"document_type": {t}}\n```', True),
    "fence without a line": ('```{"document_type": {t}}```', False),
    "trailing": ('{"document_type": {t}} thanks', False),
    "single quotes": ("{'document_type': 'x'}", False),
    "bare word": ("{document_type: x}", False),
    "list": ('[{"document_type": {t}}]', False),
    "entities null": ('{"document_type": {t}, "entities": null}', False),
    "confidence 1.5": ('{"document_type": {t}, "entities": [{"field_name": "a", "value": 1, "confidence": 1.5}]}', False),
    "confidence text": ('{"document_type": {t}, "entities": [{"field_name": "a", "value": 1, "confidence": "0.9"}]}', True),
    "confidence nan": ('{"document_type": {t}, "entities": [{"field_name": "a", "value": 1, "confidence": NaN}]}', False),
    "no value": ('{"document_type": {t}, "entities": [{"field_name": "a"}]}', False),
    "long summary": ('{"document_type": {t}, "summary": "' + "s" * 501 + '"}', False),
    "longest summary": ('{"document_type": {t}, "summary": "' + "s" * 500 + '"}', True),
    "twice": ('{"document_type": "y", "document_type": {t}}', True),
}


def json_broken(spark, d):
    """Every typed value in every kind of answer: whether it is valid, and what is read."""
    values = table(spark, d, "extractions").select(F.col("document_type").alias("t")).where("t is not null").distinct()
    quoted = F.substring(F.to_json(F.array("t")), F.lit(2), F.length(F.to_json(F.array("t"))) - 2)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("answer"), F.lit(a).alias("body")) for k, (a, _) in ANSWERS.items()])).alias("k")
    asked = values.withColumn("q", quoted).select("t", "q", kinds).select("t", "k.answer", F.replace("k.body", F.lit("{t}"), F.col("q")).alias("said"))
    return asked.withColumn("x", validate.parse_extraction("said")).select("t", "answer", F.col("x.error").isNull().alias("valid"), F.col("x.document_type").alias("read"))


def decision_parse(spark, d):
    said = F.to_json(F.struct("status", "suggested_name", "suggested_folder"), {"ignoreNullFields": "false"})
    read = _deliveries(spark, d).select("decision_id", validate.parse_decision(said).alias("x"))
    return read.select("decision_id", F.col("x.error").isNull().alias("valid"), "x.status", "x.suggested_name", "x.suggested_folder")


def rule_parse(spark, d):
    said = F.to_json(F.struct("category", "folder_structure", "naming_convention"))
    read = table(spark, d, "compiled_rules").distinct().select("rule_id", validate.parse_rule(said).alias("x"))
    return read.select("rule_id", F.col("x.error").isNull().alias("valid"), "x.category", "x.folder_structure", "x.naming_convention")


def prompts(spark, d):
    files = _deliveries(spark, d).select("decision_id", text.prompt_of(scan_plans.DECIDE_PROMPT, category=F.col("status"), folder=F.col("suggested_folder"), naming=F.lit("x"), name=F.col("suggested_name"), summary=F.lit("y")).alias("prompt"))
    rules = table(spark, d, "saved_rules").select(F.col("id").alias("decision_id"), text.prompt_of(scan_plans.COMPILE_PROMPT, instruction=F.col("query")).alias("prompt"))
    inputs = table(spark, d, "extract_inputs").select(F.col("input_id").alias("decision_id"), text.prompt_of(scan_plans.EXTRACT_PROMPT, content=F.col("document_text")).alias("prompt"))
    return files.unionByName(rules).unionByName(inputs)


def _second_time(prompt: str) -> str:
    """A model whose first answer is broken."""
    return '{"document_type": "ok"}' if "Invalid answer" in prompt else "{broken"


def repair_answers(spark, d):
    asked = table(spark, d, "saved_rules").select("id", "query")
    return asked.select("id", validate.ask(_second_time, F.col("query"), validate.EXTRACTION).alias("x")).select("id", F.col("x.error").isNull().alias("valid"), F.col("x.document_type").alias("read"))


def _third_time() -> Callable[[str], str]:
    refused: dict[str, int] = {}

    def model(prompt: str) -> str:
        refused[prompt] = refused.get(prompt, 0) + 1
        if refused[prompt] < 3:
            raise RuntimeError("429 too many requests")
        return '{"status": "move", "suggested_name": "a/b", "suggested_folder": "."}'

    return model


def retry_answers(spark, d):
    asked = table(spark, d, "saved_rules").select("id", F.concat_ws(" ", "id", "query").alias("q"))
    return asked.select("id", validate.ask(_third_time(), F.col("q"), validate.DECISION).alias("x")).select("id", F.col("x.error").isNull().alias("valid"), F.col("x.suggested_name").alias("name"))


def _compiler(prompt: str) -> str:
    """Stands for a model that takes every instruction that names all files for a rule for everything."""
    import json

    asked = prompt.split("\n", 1)[1]
    return json.dumps({"category": "any" if "toate" in asked.lower() else asked, "folder_structure": "Dosare"})


def rules_compiled(spark, d):
    made = scan_plans.compile_rules(table(spark, d, "saved_rules").select("id", "query"), _compiler)
    return made.select("id", F.col("rule.category").alias("category"), F.col("rule.folder_structure").alias("folder"), F.col("rule.naming_convention").alias("naming"))


# Stores


def store_scan(spark, d):
    q = table(spark, d, "quarantine")
    fields = ["original_path", "ai_proposed_name", "ai_proposed_folder", "reason"]
    added = q.select(F.lit("add").alias("op"), F.col("id").alias("key"), (F.col("id") * 2).alias("seq"), *fields)
    moved = q.select(F.lit("update").alias("op"), F.col("id").alias("key"), (F.col("id") * 2 + 1).alias("seq"), F.lit(None).cast("string").alias("original_path"), F.lit(None).cast("string").alias("ai_proposed_name"), F.lit("").alias("ai_proposed_folder"), F.lit(None).cast("string").alias("reason"))
    return stores.fold(added.unionByName(moved), "key", fields).select(F.col("key").alias("id"), *fields)


def store_clear(spark, d):
    """The fold of ``store_fold`` with everything ended where the greatest value of all stands."""
    e = table(spark, d, "events")
    top = e.agg(F.max("value").alias("top"))  # one row
    op = F.when(F.col("value") == F.col("top"), "clear").when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "remove")
    log = e.crossJoin(F.broadcast(top)).select(op.alias("op"), F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), "value", "props").where("op is not null")
    return stores.fold(log, "key", ["value", "props"]).select("key", "value", "props")


def clear_count(spark, d):
    """How many rows a clear at the end of ``store_fold`` would take away."""
    from .catalogue import store_fold

    return store_fold(spark, d).agg(F.count("*").alias("n"))


def store_by_id(spark, d):
    asked = _deliveries(spark, d).select(F.col("decision_id").alias("id"))
    return stores.lookup(table(spark, d, "quarantine").select("id", "original_path"), asked, "id")


def rule_by_name(spark, d):
    rules = table(spark, d, "saved_rules")
    asked = table(spark, d, "compiled_rules").select(F.col("category").alias("name")).unionByName(rules.select("name")).where("name is not null").distinct()
    return stores.lookup(rules.select("name", F.col("id").alias("rule_id")), asked, "name")


def store_insert(spark, d):
    last = table(spark, d, "quarantine").agg(F.max("id").alias("last")).first()["last"] or 0  # one number
    rows = _deliveries(spark, d).where("original_path is not null and suggested_name is not null").select("decision_id", "original_path", "suggested_name")
    return stores.numbered(rows, ["decision_id", "original_path", "suggested_name"], last).select("id", "original_path", "suggested_name")


def rule_seed(spark, d):
    rules = table(spark, d, "saved_rules").select("name", "query", "folder_template", "naming_template")
    parts = [stores.seeded(r, stores.RuleStore.DEFAULT).withColumn("table", F.lit(t)) for t, r in (("full", rules), ("empty", rules.where("false")))]
    return parts[0].unionByName(parts[1])


def rule_save(spark, d):
    saves = table(spark, d, "compiled_rules").distinct().select(F.col("saved_rule_id").alias("name"), "rule_id", "category", "folder_structure", "naming_convention")
    return stores.saved(saves, "name", ["rule_id", "category", "folder_structure", "naming_convention"]).select("name", "id", "category")


def rule_delete(spark, d):
    """Deleting by every category that somebody typed: it succeeds whether or not there is such a preset."""
    rules = table(spark, d, "saved_rules")
    asked = table(spark, d, "compiled_rules").select(F.col("category").alias("name")).where("name is not null").distinct()
    left = rules.join(asked, "name", "left_anti").agg(F.count("*").alias("left"))
    return asked.withColumn("deleted", F.lit(True)).crossJoin(left)  # one row


# Review


def _edits(spark: SparkSession, d: str) -> DataFrame:
    """The latest decision on each path as an edit of the rows under review."""
    latest = stores.latest_by(_deliveries(spark, d).select("original_path", "decided_at", "decision_id", "status", "suggested_name", "suggested_folder"), "original_path", ["decided_at", "decision_id"])
    return table(spark, d, "quarantine").select("id", "original_path").join(latest, "original_path").select("id", "status", F.col("suggested_name").alias("name"), F.col("suggested_folder").alias("folder"))


def approve_plan(spark, d):
    there = table(spark, d, "extractions").select(F.col("original_path").alias("path"))
    return review.approvals(table(spark, d, "quarantine"), _edits(spark, d), there)


def reject_plan(spark, d):
    rejected = _edits(spark, d).where("status = 'quarantine'")
    return review.remaining(table(spark, d, "quarantine").select("id", "original_path"), rejected)


def first_row(spark, d):
    return table(spark, d, "quarantine").orderBy("id").limit(1).select("id", "original_path")


# Undo


def _moves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("there"))


def history_list(spark, d):
    return history.in_order(_moves(spark, d), ["user_id"], ORDER).select("user_id", "ordinal", "event_id")


def last_action(spark, d):
    return history.last_action(_moves(spark, d), ORDER).select("user_id", "event_id")


def undo_last(spark, d):
    return history.undo_last(_moves(spark, d), ["user_id"], ORDER, "there").select("user_id", "event_id", "undone", "left")


def undo_index(spark, d):
    """Undo at a place for every user: as many as the user had errors, less two, so that some lie outside the list."""
    asked = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") - 2).cast("int").alias("index"))
    return history.undo_at(_moves(spark, d), asked, ["user_id"], ORDER, "there")


def move_sources(spark, d):
    there = table(spark, d, "quarantine").select(F.col("original_path").alias("path"))
    return history.with_sources(_deliveries(spark, d).select("decision_id", "original_path"), there, "original_path").select("decision_id", "found")


# The scan


def _presets(spark: SparkSession, category: str, naming: str) -> DataFrame:
    return spark.createDataFrame([(category, "Dosare/noi", naming)], "category string, folder_structure string, naming_convention string")


def scan_pipeline(spark, d):
    """The whole scan of the files that are not under review, with a model that keeps everything for review."""
    files = scan.visible_files(_files(spark, d))
    plan = scan_plans.plan_scan(files, table(spark, d, "quarantine"), _presets(spark, "facturi", "x"), readers={k: (lambda p: "") for k in ("pdf", "docx", "image", "text")})
    return plan.select("path", "outcome", "target_folder", "target", "reason")


def bypass_plan(spark, d):
    """A rule for everything over every file with an extraction: images by their caption, the others by the suggested name."""
    latest = stores.latest_by(table(spark, d, "extractions").select("original_path", "extracted_at", "extraction_id", "summary", "suggested_filename").distinct(), "original_path", ["extracted_at", "extraction_id"])
    files = _files(spark, d).join(latest, F.col("path") == F.col("original_path"))
    seen = F.when(F.col("kind") == "image", text.image_text(F.coalesce("summary", F.lit("")), F.lit("scan"))).otherwise(F.coalesce("summary", F.lit("")))
    ruled = scan.apply_rule(files.withColumns({"content": seen, "summary_name": F.col("suggested_filename")}), _presets(spark, " ANY\n", " descriptive_name_based_on_content "))
    return scan.bypass_decision(ruled.where(scan.bypasses(F.col("category")))).select("path", F.col("suggested_name").alias("name"), F.col("suggested_folder").alias("folder"), "status")


def review_inserts(spark, d):
    """What the scan puts under review, with the ids that the store gives."""
    rows = scan_plans.review_rows(scan_pipeline(spark, d))
    last = table(spark, d, "quarantine").agg(F.max("id").alias("last")).first()["last"] or 0  # one number
    return stores.numbered(rows, ["order"], last).select("id", "original_path", "ai_proposed_name", "ai_proposed_folder", "reason")


def collisions_existing(spark, d):
    """Names for every suggested name beside the files that lie there under the names under review."""
    names = _deliveries(spark, d).where("suggested_name is not null and original_path is not null")
    moves = names.select(F.concat_ws("#", "original_path", F.lpad(F.col("decision_id").cast("string"), 12, "0")).alias("path"), paths.parent(F.col("original_path")).alias("folder"), F.col("suggested_name").alias("name"))
    there = table(spark, d, "quarantine").where("ai_proposed_name is not null").select(paths.parent(F.col("original_path")).alias("folder"), F.col("ai_proposed_name").alias("name"))
    return collisions.plan_targets(moves, there).select("path", "target")


LATEST_SQL = "(select *, row_number() over (partition by original_path order by decided_at desc, decision_id desc) as r from (select distinct * from decisions))"
EDITS_SQL = f"(select q.id, l.status, l.suggested_name as name, l.suggested_folder as folder, q.original_path as path from quarantine q join {LATEST_SQL} l on l.original_path = q.original_path and l.r = 1)"
KEPT_SQL = "(select user_id, event_id, there, row_number() over (partition by user_id order by ts, event_id) as ordinal, count(*) over (partition by user_id) as n from (select user_id, ts, event_id, event_type <> 'error' as there, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 50)"
SAFE_SQL = "regexp_replace({c}, '[<>:\"/\\\\|?*]', '_', 'g')"
PARENT_SQL = "regexp_extract(original_path, '^((?s:.*))/[^/]*$', 1)"

#: The greedy rule followed row by row: all groups (folder, and name without numbers) take their next row at the same time.
COLLISIONS_SQL = """
with recursive moves as (select path, folder, name, regexp_replace(name, '_[0-9]+', '', 'g') as base from ({moves}) where name is not null and folder is not null),
m as (select *, row_number() over (partition by folder, base order by path) as i, regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1) as suffix from moves),
there as (select folder, regexp_replace(name, '_[0-9]+', '', 'g') as base, list(distinct name) as used from ({there}) where folder is not null and name is not null group by 1, 2),
step as (
  select folder, base, cast(0 as bigint) as i, cast(null as varchar) as path, cast(null as varchar) as target, coalesce(used, []) as used from (select distinct folder, base from m) g left join there using (folder, base)
  union all
  select folder, base, i, path, target, list_append(used, target) as used from (
    select s.folder, s.base, m.i, m.path, s.used, case when not list_contains(s.used, m.name) then m.name else left(m.name, length(m.name) - length(m.suffix)) || '_' ||
      list_min(list_filter(range(1, len(s.used) + 2), lambda n: not list_contains(s.used, left(m.name, length(m.name) - length(m.suffix)) || '_' || n || m.suffix))) || m.suffix end as target
    from step s join m on m.folder = s.folder and m.base = s.base and m.i = s.i + 1))
select path, target from step where i > 0
"""


def _prompt_sql(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', coalesce({value}, ''))"
    return out


def oracle_sql() -> dict[str, str]:
    strip = text.strip_sql
    safe = lambda c: SAFE_SQL.format(c=c)
    key = "case when reason = '' then ' your_api_key_here' || chr(10) else reason end"
    usable = f"coalesce({strip(key)} not in ('', 'your_api_key_here'), false)"
    mime = "case lower(suffix) when '.png' then 'image/png' when '.bmp' then 'image/bmp' else 'image/jpeg' end"
    answers = ", ".join(f"('{k}', {str(v).lower()}, {str(k == 'single quotes').lower()})" for k, (_, v) in ANSWERS.items())
    status = "coalesce(status in ('move', 'quarantine'), false)"
    suffixed = lambda c: f"case when ends_with(lower({c}), lower(suffix)) then {c} else {c} || suffix end"
    caption = f"regexp_replace(replace({strip('summary')}, ' ', '_'), '[^a-zA-Z0-9_-]', '', 'g')"
    marker = f"split_part(coalesce(summary, ''), '{text.MARKER}', 1)"
    caption = strip(f"split_part({marker}, '{text.OCR_MARKER}', 1)")
    kept = f"regexp_replace(replace({caption}, ' ', '_'), '[^a-zA-Z0-9_-]', '', 'g')"
    described = f"case when {caption} = '' or starts_with({caption}, 'Eroare') or {kept} = '' then name else {suffixed(kept)} end"
    named = f"case when coalesce(suggested_filename, '') <> '' then {suffixed('suggested_filename')} else name end"
    dispatch = f"""case kind when 'pdf' then 'pdf ' || path when 'docx' then '{text.EMPTY_CONTENT}' when 'text' then 'Eroare extracție: unreadable' when 'image' then '{text.MARKER}' || chr(10) ||
      case lower(suffix) when '.bmp' then 'Eroare Vision AI: no such model' when '.tiff' then '' else 'Un dosar' end || chr(10) || chr(10) || '{text.OCR_MARKER}' || chr(10)
      else 'Fișier de tip necunoscut (' || lower(suffix) || '). Conținut text nedisponibil.' end"""
    pipeline = f"select path, 'quarantine' as outcome, 'Quarantine' as target_folder, {safe('name')} as target, 'Decizie AI (quarantine) bazată pe: ...' as reason from ({INVENTORY_SQL}) f where not starts_with(name, '.') and not exists (select 1 from quarantine q where q.original_path = f.path)"
    fold = """
with t as (select max(value) as top from events), l as (select case when value = top then 'clear' when event_type = 'signup' then 'add' when event_type = 'click' then 'update' when event_type = 'error' then 'remove' end as op, user_id as key,
  cast(epoch_us(ts) as hugeint) * 1000000000000 + event_id as seq, value, props from events, t),
c as (select max(seq) as cleared from l where op = 'clear'), r as (select l.* from l, c where op in ('add', 'update', 'remove') and (cleared is null or seq > cleared)),
a as (select key, max(seq) filter (op = 'add') as added, max(seq) filter (op = 'remove') as removed from r group by key),
k as (select r.* from r join a using (key) where added is not null and (removed is null or removed < added) and seq >= added and op in ('add', 'update'))
select key, arg_max(value, seq) as value, arg_max(props, seq) as props from k group by key
"""
    from .catalogue import FOLD_SQL

    hard = "select concat_ws('#', original_path, cast(decision_id as varchar)) as path, 'dest' as folder, suggested_name as name from (select distinct * from decisions)"
    moves = f"select original_path || '#' || lpad(cast(decision_id as varchar), 12, '0') as path, {PARENT_SQL} as folder, suggested_name as name from (select distinct * from decisions) where suggested_name is not null and original_path is not null"
    there = f"select {PARENT_SQL} as folder, ai_proposed_name as name from quarantine"
    nobody = "select '' as folder, '' as name where false"
    return {
        "unknown_type": f"select path, 'Fișier de tip necunoscut (' || lower(suffix) || '). Conținut text nedisponibil.' as content from ({INVENTORY_SQL}) where {_kind_sql('suffix')} = 'unknown'",
        "image_text": f"select doc_id, '{text.MARKER}' || chr(10) || coalesce(source, '') || chr(10) || chr(10) || '{text.OCR_MARKER}' || chr(10) || coalesce(text, '') as content from documents",
        "image_payload": f"select path, 'data:' || {mime} || ';base64,' || base64(encode(path)) as url from ({INVENTORY_SQL}) where {_kind_sql('suffix')} = 'image'",
        "plain_text": "select doc_id, text as content from documents where text is not null",
        "docx_paragraphs": f"select input_id, array_to_string(list_filter(string_split(document_text, chr(10)), lambda x: {strip('x')} <> ''), chr(10)) as content from extract_inputs",
        "first_pages": f"select input_id, {strip("array_to_string(list_slice(string_split(document_text, chr(10) || chr(10)), 1, 2), chr(10))")} as content from extract_inputs",
        "content_dispatch": f"select path, {dispatch} as content from (select *, {_kind_sql('suffix')} as kind from ({INVENTORY_SQL}))",
        "summary_length": "select doc_id, length(text) <= 500 as valid from documents",
        "rate_limits": "select id, contains(concat_ws(' ', original_path, reason), '429') as again from quarantine",
        "key_usable": f"select id, {usable} as usable, case when {usable} then 'cloud' else 'local' end as provider from quarantine",
        "payload_flatten": "select distinct extraction_id, concat_ws(' ', document_type, summary, suggested_filename) as said from extractions",
        "json_broken": f"select t, answer, valid, case when valid then t end as read from (select distinct document_type as t from extractions where document_type is not null) x cross join (values {answers}) v(answer, valid, own)",
        "decision_parse": f"select decision_id, {status} as valid, case when {status} then status end as status, case when {status} then {safe('suggested_name')} end as suggested_name, case when {status} then suggested_folder end as suggested_folder from (select distinct * from decisions)",
        "rule_parse": "select rule_id, valid, case when valid then category end as category, case when valid then folder_structure end as folder_structure, case when valid then coalesce(naming_convention, '{original_filename}') end as naming_convention from (select distinct *, category is not null and folder_structure is not null as valid from compiled_rules)",
        "prompts": f"select decision_id, {_prompt_sql(scan_plans.DECIDE_PROMPT, category='status', folder='suggested_folder', naming=chr(39) + 'x' + chr(39), name='suggested_name', summary=chr(39) + 'y' + chr(39))} as prompt from (select distinct * from decisions) union all select id, {_prompt_sql(scan_plans.COMPILE_PROMPT, instruction='query')} from saved_rules union all select input_id, {_prompt_sql(scan_plans.EXTRACT_PROMPT, content='document_text')} from extract_inputs",
        "repair_answers": "select id, true as valid, 'ok' as read from saved_rules",
        "retry_answers": "select id, true as valid, 'a_b' as name from saved_rules",
        "rules_compiled": "select id, case when contains(lower(coalesce(query, '')), 'toate') then 'any' else coalesce(query, '') end as category, 'Dosare' as folder, '{original_filename}' as naming from saved_rules",
        "store_scan": "select id, original_path, ai_proposed_name, '' as ai_proposed_folder, reason from quarantine",
        "store_clear": fold,
        "clear_count": f"select count(*) as n from ({FOLD_SQL})",
        "store_by_id": "select d.id, q.original_path, q.id is not null as found from (select decision_id as id from (select distinct * from decisions)) d left join quarantine q using (id)",
        "rule_by_name": "select n.name, r.id as rule_id, r.id is not null as found from (select category as name from compiled_rules where category is not null union select name from saved_rules where name is not null) n left join saved_rules r using (name)",
        "store_insert": "select (select max(id) from quarantine) + row_number() over (order by decision_id, original_path, suggested_name) as id, original_path, suggested_name from (select distinct * from decisions) where original_path is not null and suggested_name is not null",
        "rule_seed": "select name, query, folder_template, naming_template, 'full' as \"table\" from saved_rules union all select 'Smart Auto-Sort (Default)', 'Toate fișierele', '', '[An]_[Emitent]_[SubiectAI]', 'empty'",
        "rule_save": "select name, max(n) as id, arg_max(category, n) as category from (select saved_rule_id as name, category, row_number() over (order by rule_id, category nulls first, folder_structure nulls first, naming_convention nulls first) as n from (select distinct * from compiled_rules)) group by name",
        "rule_delete": "select name, true as deleted, (select count(*) from saved_rules where name not in (select category from compiled_rules where category is not null)) as \"left\" from (select distinct category as name from compiled_rules where category is not null)",
        "approve_plan": f"select id, path, {strip('name')} as name, {strip('folder')} as folder, case when not coalesce({strip('name')} <> '' and {strip('folder')} <> '', false) then 'incomplete' when not exists (select 1 from extractions x where x.original_path = e.path) then 'vanished' else 'move' end as outcome, coalesce({strip('name')} <> '' and {strip('folder')} <> '', false) as removed from {EDITS_SQL} e",
        "reject_plan": f"select id, original_path from quarantine where id not in (select id from {EDITS_SQL} where status = 'quarantine')",
        "first_row": "select id, original_path from quarantine order by id limit 1",
        "history_list": f"select user_id, ordinal, event_id from {KEPT_SQL}",
        "last_action": "select user_id, event_id from events order by ts desc, event_id desc limit 1",
        "undo_last": f"select user_id, event_id, there as undone, n - 1 as \"left\" from {KEPT_SQL} where ordinal = n",
        "undo_index": f"select user_id, index, undone, n - cast(undone as int) as \"left\" from (select a.user_id, a.index, coalesce(k.there, false) as undone, s.n from (select user_id, cast(count(*) filter (event_type = 'error') - 2 as integer) as index from events group by user_id) a join (select user_id, max(n) as n from {KEPT_SQL} group by user_id) s using (user_id) left join {KEPT_SQL} k on k.user_id = a.user_id and k.ordinal - 1 = a.index)",
        "move_sources": "select decision_id, original_path is not null and original_path in (select original_path from quarantine) as found from (select distinct * from decisions)",
        "scan_pipeline": pipeline,
        "bypass_plan": f"select path, {safe(f'case when {_kind_sql("suffix")} = {chr(39)}image{chr(39)} then {described} else {named} end')} as name, 'Dosare/noi' as folder, 'move' as status from ({INVENTORY_SQL}) f join (select *, row_number() over (partition by original_path order by extracted_at desc, extraction_id desc, suggested_filename desc) as r from (select distinct original_path, extracted_at, extraction_id, summary, suggested_filename from extractions)) x on x.original_path = f.path and r = 1",
        "review_inserts": f"select (select max(id) from quarantine) + row_number() over (order by path) as id, path as original_path, target as ai_proposed_name, target_folder as ai_proposed_folder, reason from ({pipeline})",
        "collisions_existing": COLLISIONS_SQL.format(moves=moves, there=there),
        "collision_plan_hard": COLLISIONS_SQL.format(moves=hard, there=nobody),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [unknown_type, image_text, image_payload, plain_text, docx_paragraphs, first_pages, content_dispatch, summary_length, rate_limits, key_usable, payload_flatten, json_broken, decision_parse, rule_parse, prompts, repair_answers, retry_answers, rules_compiled, store_scan, store_clear, clear_count, store_by_id, rule_by_name, store_insert, rule_seed, rule_save, rule_delete, approve_plan, reject_plan, first_row, history_list, last_action, undo_last, undo_index, move_sources, scan_pipeline, bypass_plan, review_inserts, collisions_existing]
    return {f.__name__: f for f in plain}
