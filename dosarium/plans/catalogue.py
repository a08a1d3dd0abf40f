"""The queries of the routing engine over the given tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text, validate
from ..operators import collisions, history, ranking, scan, stores
from ..session import table

FLAGSHIP = "scan_plan"
SUFFIX = r"regexp_extract(regexp_extract({p}, '[^/]*$'), '(?s)^.+(\.[^.]+)$', 1)"
NAME = "regexp_extract({p}, '[^/]*$')"


def _kind_sql(suffix: str) -> str:
    cases = " ".join(f"when lower({suffix}) in ({', '.join(repr(s) for s in group)}) then '{k}'" for k, group in paths.KINDS.items())
    return f"case {cases} else 'unknown' end"


FILES_SQL = "select distinct original_path as path from decisions where original_path is not null"
INVENTORY_SQL = f"select path, {NAME.format(p='path')} as name, {SUFFIX.format(p='path')} as suffix from ({FILES_SQL})"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return scan.inventory(table(spark, d, "decisions"), "original_path")


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Decisions, each once."""
    return table(spark, d, "decisions").distinct()


def scan_visible(spark, d):
    return scan.visible_files(_files(spark, d)).select("path", "name")


def scan_new(spark, d):
    return scan.new_files(_files(spark, d), table(spark, d, "quarantine")).select("path")


def scan_skipped(spark, d):
    return scan.skipped_files(_files(spark, d), table(spark, d, "quarantine")).select("path")


def kind_dispatch(spark, d):
    return _files(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def scan_summary(spark, d):
    outcomes = scan.route(_deliveries(spark, d))
    return scan.scan_summary(_files(spark, d), table(spark, d, "quarantine"), outcomes)


def path_parts(spark, d):
    c = F.col("path")
    return _files(spark, d).select("path", "name", "suffix", paths.stem(c).alias("stem"), paths.parent(c).alias("parent"))


def append_suffix(spark, d):
    names = _deliveries(spark, d).where("suggested_name is not null and original_path is not null")
    return names.select("decision_id", paths.append_suffix(F.col("suggested_name"), paths.suffix(F.col("original_path"))).alias("name"))


def sanitize_name(spark, d):
    return table(spark, d, "saved_rules").select("id", text.sanitise(F.col("naming_template")).alias("template"), text.sanitise(F.col("query")).alias("query"))


def descriptive_name(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    wrapped = text.image_text(F.col("text"), F.lit("x"))
    return docs.select("doc_id", text.descriptive_name(wrapped, F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".jpeg")), F.lit(".jpeg")).alias("name"))


def technical_summary(spark, d):
    return table(spark, d, "extractions").select("extraction_id", text.technical_summary(F.col("summary")).alias("summary"))


def reason_text(spark, d):
    return table(spark, d, "extractions").select("extraction_id", text.reason_text(F.lit("quarantine"), F.col("summary")).alias("reason"))


def null_display(spark, d):
    return table(spark, d, "quarantine").select("id", text.null_display(F.col("reason")).alias("shown"))


def content_default(spark, d):
    return table(spark, d, "extract_inputs").select("input_id", text.content_or_default(F.col("document_text")).alias("content"))


def template_fill(spark, d):
    rules = table(spark, d, "saved_rules").select("id", "name", "naming_template", "created_at")
    values = {"year": F.year("created_at").cast("string"), "month": F.lpad(F.month("created_at").cast("string"), 2, "0"), "document_type": F.lit("factură"), "issuer": F.substring_index("name", " ", -1)}
    return rules.select("id", text.fill_template(F.col("naming_template"), values).alias("filled"))


def progress(spark, d):
    files = ranking.ranked(_files(spark, d).select("path"), [], ["path"])
    total = files.agg(F.count("*").alias("total"))
    return files.crossJoin(F.broadcast(total)).select("path", text.progress(F.col("rank"), F.col("total")).alias("percent"))


def log_severity(spark, d):
    c = F.col("reason")
    return table(spark, d, "quarantine").where("reason is not null").select("id", text.log_severity(c).alias("severity"), text.log_cleanup(c).alias("shown"))


def mime_types(spark, d):
    return _files(spark, d).where("kind = 'image'").select("path", paths.mime(F.col("path")).alias("mime"), paths.previewable(F.col("path")).alias("preview"))


def store_fold(spark, d):
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "remove")
    log = table(spark, d, "events").select(op.alias("op"), F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), "value", "props").where("op is not null")
    return stores.fold(log, "key", ["value", "props"]).select("key", "value", "props")


def rule_upsert(spark, d):
    newest = stores.latest_by(table(spark, d, "compiled_rules").select("saved_rule_id", "rule_id", "category"), "saved_rule_id", ["rule_id"])
    return newest.select("saved_rule_id", "rule_id", "category")


def rules_ordered(spark, d):
    return stores.newest_first(table(spark, d, "saved_rules").select("id", "name", "created_at"))


def rule_lookup(spark, d):
    rules = table(spark, d, "saved_rules")
    return rules.where(F.col("id") == 2).select("id", "name", "query")


def history_last_50(spark, d):
    return history.newest(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def json_strict(spark, d):
    e = table(spark, d, "entities")
    answer = F.to_json(F.struct("field_name", "value", "confidence", "reasoning"), {"ignoreNullFields": "false"})
    wrapped = F.concat(F.lit('{"document_type": "x", "entities": ['), answer, F.lit("]}"))
    return e.select("entity_id", validate.parse_extraction(wrapped).alias("x")).select("entity_id", F.col("x.error").isNull().alias("valid")).distinct()


def entities_valid(spark, d):
    return table(spark, d, "entities").select("entity_id", F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False)).alias("valid"), "field_name").distinct()


def entity_counts(spark, d):
    e = table(spark, d, "entities").groupBy("extraction_id").agg(F.count("*").alias("n"))
    x = table(spark, d, "extractions").select("extraction_id").distinct()
    return x.join(e, "extraction_id", "left").select("extraction_id", F.coalesce("n", F.lit(0)).alias("n"))


def paragraphs_long(spark, d):
    lines = table(spark, d, "extract_inputs").select("input_id", F.posexplode(F.split("document_text", "\n")).alias("line_no", "line"))
    return lines.where(text.strip(F.col("line")) != "").select("input_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def status_routing(spark, d):
    return scan.route(_deliveries(spark, d)).select("decision_id", "outcome", "target_folder")


def folder_escapes(spark, d):
    folders = _deliveries(spark, d).where("suggested_folder is not null")
    return folders.select("decision_id", paths.escapes(F.col("suggested_folder")).alias("refused"), paths.join(F.lit("/dest"), F.col("suggested_folder")).alias("folder"))


def rule_apply(spark, d):
    r = table(spark, d, "compiled_rules").distinct()
    folder = paths.folder_or_default(F.col("folder_structure"), text.strip(F.col("folder_structure")))
    return r.select("rule_id", scan.bypasses(F.col("category")).alias("bypass"), scan.naming_mode(F.col("naming_convention")).alias("mode"), folder.alias("folder"))


def edit_form_valid(spark, d):
    return _deliveries(spark, d).select("decision_id", scan.valid_approval(F.col("suggested_name"), F.col("suggested_folder")).alias("valid"))


def rule_form_valid(spark, d):
    return table(spark, d, "saved_rules").select("id", scan.valid_rule(F.col("name"), F.col("query"), F.col("naming_template")).alias("valid"))


def collision_plan(spark, d):
    moves = table(spark, d, "quarantine").select(F.lpad(F.col("id").cast("string"), 12, "0").alias("path"), F.lit("dest").alias("folder"), F.concat(F.replace("ai_proposed_folder", F.lit("/"), F.lit(" ")), F.lit(".x")).alias("name"))
    return collisions.plan_targets(moves).select("path", "target")


def collision_plan_hard(spark, d):
    moves = _deliveries(spark, d).select(F.concat_ws("#", "original_path", F.col("decision_id").cast("string")).alias("path"), F.lit("dest").alias("folder"), F.col("suggested_name").alias("name"))
    return collisions.plan_targets(moves).select("path", "target")


def scan_plan(spark, d):
    """The routing of every new file by the decisions at hand: hidden and reviewed files out, outcome, folder, reason."""
    new = scan.new_files(scan.visible_files(_files(spark, d)), table(spark, d, "quarantine"))
    latest = stores.latest_by(_deliveries(spark, d).select("original_path", "decided_at", "decision_id", "status", "suggested_name", "suggested_folder"), "original_path", ["decided_at", "decision_id"])
    routed = scan.route(new.join(latest, new["path"] == latest["original_path"]))
    named = F.when(F.col("outcome") != "error", paths.append_suffix(text.sanitise(F.col("suggested_name")), F.col("suffix")))
    return routed.select("path", "kind", "outcome", "target_folder", named.alias("target"))


FOLD_SQL = """
with l as (select case event_type when 'signup' then 'add' when 'click' then 'update' when 'error' then 'remove' end as op, user_id as key,
  cast(epoch_us(ts) as hugeint) * 1000000000000 + event_id as seq, value, props from events where event_type in ('signup', 'click', 'error')),
a as (select key, max(seq) filter (op = 'add') as added, max(seq) filter (op = 'remove') as removed from l group by key),
k as (select l.* from l join a using (key) where added is not null and (removed is null or removed < added) and seq >= added and op in ('add', 'update'))
select key, arg_max(value, seq) as value, arg_max(props, seq) as props from k group by key
"""
STATUS = "coalesce(status in ('move', 'quarantine'), false)"
OUTCOME = f"case when not {STATUS} or suggested_name is null then 'error' when status = 'move' and suggested_folder is null then 'error' else status end"


def oracle_sql() -> dict[str, str]:
    s, n = SUFFIX.format(p="path"), NAME.format(p="path")
    suffix_of = SUFFIX.format(p="original_path")
    strip = text.strip_sql
    safe = lambda c: f"regexp_replace({c}, '[<>:\"/\\\\|?*]', '_', 'g')"
    fence = {"[An]": "cast(year(created_at) as varchar)", "[Luna]": "lpad(cast(month(created_at) as varchar), 2, '0')", "[TipDocument]": "'factură'", "[Emitent]": "regexp_extract(name, '[^ ]*$')"}
    filled = "naming_template"
    for token, value in fence.items():
        filled = f"replace({filled}, '{token}', {value})"
    severity = " ".join(f"when {' or '.join(f"contains(lower(reason), '{w}')" for w in words)} then '{k}'" for k, words in text.SEVERITIES)
    caption = strip(f"split_part(text, '{text.MARKER}', 1)")
    caption = strip(f"split_part(split_part(text, '{text.MARKER}', 1), '{text.OCR_MARKER}', 1)")
    kept = f"regexp_replace(replace({caption}, ' ', '_'), '[^a-zA-Z0-9_-]', '', 'g')"
    return {
        "scan_visible": f"select path, name from ({INVENTORY_SQL}) where not starts_with(name, '.')",
        "scan_new": f"select path from ({FILES_SQL}) f where not exists (select 1 from quarantine q where q.original_path = f.path)",
        "scan_skipped": f"select path from ({FILES_SQL}) f where exists (select 1 from quarantine q where q.original_path = f.path)",
        "kind_dispatch": f"select {_kind_sql('suffix')} as kind, count(*) as n from ({INVENTORY_SQL}) group by 1",
        "scan_summary": f"select (select count(*) from ({FILES_SQL})) as total, (select count(*) from ({FILES_SQL}) f where exists (select 1 from quarantine q where q.original_path = f.path)) as skipped, count(*) filter (o <> 'error') as added, count(*) filter (o = 'error') as failed from (select {OUTCOME} as o from (select distinct * from decisions))",
        "path_parts": f"select path, {n} as name, {s} as suffix, left({n}, length({n}) - length({s})) as stem, regexp_extract(path, '^((?s:.*))/[^/]*$', 1) as parent from ({FILES_SQL})",
        "append_suffix": f"select decision_id, case when ends_with(lower(suggested_name), lower({suffix_of})) then suggested_name else suggested_name || {suffix_of} end as name from (select distinct * from decisions) where suggested_name is not null and original_path is not null",
        "sanitize_name": f"select id, {safe('naming_template')} as template, {safe('query')} as query from saved_rules",
        "descriptive_name": f"select doc_id, case when c = '' or starts_with(c, 'Eroare') or k = '' then 'doc_' || doc_id || '.jpeg' when ends_with(lower(k), '.jpeg') then k else k || '.jpeg' end as name from (select doc_id, {caption} as c, {kept} as k from documents where text is not null)",
        "technical_summary": "select extraction_id, substring(summary, 1, 200) as summary from extractions",
        "reason_text": "select extraction_id, 'Decizie AI (quarantine) bazată pe: ' || substring(summary, 1, 100) || '...' as reason from extractions",
        "null_display": "select id, coalesce(nullif(reason, ''), '—') as shown from quarantine",
        "content_default": f"select input_id, case when document_text is null or document_text = '' then '{text.EMPTY_CONTENT}' else document_text end as content from extract_inputs",
        "template_fill": f"select id, {filled} as filled from saved_rules",
        "progress": f"select path, cast(trunc(cast(r as double) / cast(t as double) * 100) as integer) as percent from (select path, row_number() over (order by path) as r, count(*) over () as t from ({FILES_SQL}))",
        "log_severity": f"select id, case when {strip('reason')} = '' then null {severity} else 'default' end as severity, replace({strip('reason')}, '\\n', '<br>') as shown from quarantine where reason is not null",
        "mime_types": f"select path, case lower(suffix) when '.png' then 'image/png' when '.bmp' then 'image/bmp' else 'image/jpeg' end as mime, lower(suffix) in ('.png', '.jpg', '.jpeg', '.bmp') as preview from ({INVENTORY_SQL}) where {_kind_sql('suffix')} = 'image'",
        "store_fold": FOLD_SQL,
        "rule_upsert": "select saved_rule_id, rule_id, category from (select *, row_number() over (partition by saved_rule_id order by rule_id desc, category desc) as r from compiled_rules) where r = 1",
        "rules_ordered": "select id, name, created_at from saved_rules order by created_at desc, id desc",
        "rule_lookup": "select id, name, query from saved_rules where id = 2",
        "history_last_50": "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 50",
        "json_props": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
        "json_strict": "select distinct entity_id, coalesce(confidence between 0 and 1 and not isnan(confidence), false) and field_name is not null and reasoning is not null as valid from entities",
        "entities_valid": "select distinct entity_id, coalesce(confidence between 0 and 1 and not isnan(confidence), false) as valid, field_name from entities",
        "entity_counts": "select extraction_id, count(entity_id) as n from (select distinct extraction_id from extractions) x left join entities e using (extraction_id) group by 1",
        "paragraphs_long": f"select input_id, line_no, line from (select input_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select input_id, string_split(document_text, chr(10)) as l from extract_inputs)) where {strip('line')} <> ''",
        "status_routing": f"select decision_id, outcome, case outcome when 'quarantine' then 'Quarantine' when 'move' then suggested_folder end as target_folder from (select *, {OUTCOME} as outcome from (select distinct * from decisions))",
        "folder_escapes": "select decision_id, starts_with(suggested_folder, '/') or regexp_matches(suggested_folder, '(^|/)\\.\\.(/|$)') as refused, case when starts_with(suggested_folder, '/') then suggested_folder when suggested_folder in ('.', '') then '/dest' else '/dest/' || suggested_folder end as folder from (select distinct * from decisions) where suggested_folder is not null",
        "rule_apply": f"select distinct rule_id, lower({strip('category')}) in ('any', 'all') as bypass, case when {strip('naming_convention')} in ('descriptive_name_based_on_content', '') then 'descriptive' when {strip('naming_convention')} = '{{original_filename}}' then 'original' when naming_convention is not null then 'template' end as mode, case when lower({strip('folder_structure')}) in ('any', 'all', '') then 'Organized' else folder_structure end as folder from (select distinct * from compiled_rules)",
        "edit_form_valid": f"select decision_id, coalesce({strip('suggested_name')} <> '' and {strip('suggested_folder')} <> '', false) as valid from (select distinct * from decisions)",
        "rule_form_valid": f"select id, coalesce({strip('name')} <> '' and {strip('query')} <> '' and {strip('naming_template')} <> '', false) as valid from saved_rules",
        "collision_plan": "select lpad(cast(id as varchar), 12, '0') as path, case when r = 1 then n else regexp_replace(n, '\\.x$', '') || '_' || (r - 1) || '.x' end as target from (select id, replace(ai_proposed_folder, '/', ' ') || '.x' as n, row_number() over (partition by ai_proposed_folder order by id) as r from quarantine where ai_proposed_folder is not null)",
        "scan_plan": f"select path, {_kind_sql('suffix')} as kind, outcome, case outcome when 'quarantine' then 'Quarantine' when 'move' then suggested_folder end as target_folder, case when outcome <> 'error' then case when ends_with(lower({safe('suggested_name')}), lower(suffix)) then {safe('suggested_name')} else {safe('suggested_name')} || suffix end end as target from (select *, {OUTCOME} as outcome from ({INVENTORY_SQL}) f join (select *, row_number() over (partition by original_path order by decided_at desc, decision_id desc) as r from (select distinct * from decisions)) d on f.path = d.original_path and r = 1 where not starts_with(name, '.') and not exists (select 1 from quarantine q where q.original_path = f.path))",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [scan_visible, scan_new, scan_skipped, kind_dispatch, scan_summary, path_parts, append_suffix, sanitize_name, descriptive_name, technical_summary, reason_text, null_display, content_default, template_fill, progress, log_severity, mime_types, store_fold, rule_upsert, rules_ordered, rule_lookup, history_last_50, json_props, json_strict, entities_valid, entity_counts, paragraphs_long, status_routing, folder_escapes, rule_apply, edit_form_valid, rule_form_valid, collision_plan, collision_plan_hard, scan_plan]
    return {f.__name__: f for f in plain}
