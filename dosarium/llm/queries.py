"""The queries of the training-data operators, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, canonical_list, confusables, history_dedup, leakage, name_variants, residue, scan_repair, spam


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = history_dedup.dedup_batches(table(spark, sf_dir, "quarantine"))
    return links.where("batch >= 1").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))


def p2_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec_id, text, residue): every name and template with what its most telling window is."""
    sources = (("quarantine", "id", "ai_proposed_name", False), ("decisions", "decision_id", "suggested_name", False), ("saved_rules", "id", "naming_template", True))
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("src"), F.col(k).alias("rec_id"), F.col(c).alias("text"), F.lit(m).alias("template")) for t, k, c, m in sources]
    natural = table(spark, sf_dir, "entities").select(F.col("value").alias("text")).unionByName(table(spark, sf_dir, "documents").select("text"))
    for t in ("quarantine", "decisions"):
        natural = natural.unionByName(table(spark, sf_dir, t).select(F.col("original_path").alias("text")))
    return residue.find_residue(parts[0].unionByName(parts[1]).unionByName(parts[2]), natural, "text", "template").drop("template")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_residue(spark, sf_dir).where("residue.kind is not null").select("src", "rec_id").distinct()


#: Values that name no type, without regard to case and outer blanks.
NO_TYPE = ("any", "all", "unknown")


def p3_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, rec_id, value, type_id): every typed value with the entry it means; null where it names no type."""
    typed = table(spark, sf_dir, "extractions").select(F.lit("extractions").alias("src"), F.col("extraction_id").alias("rec_id"), F.col("document_type").alias("value"))
    typed = typed.unionByName(table(spark, sf_dir, "compiled_rules").select(F.lit("compiled_rules").alias("src"), F.col("rule_id").alias("rec_id"), F.col("category").alias("value")))
    entries = canonical_list.list_entries(table(spark, sf_dir, "doc_types"), typed, "type_id", "label", ["label_en", "aliases"])
    return canonical_list.map_values(typed, entries, NO_TYPE).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "doc_types").select(F.col("label").alias("value"))  # a fixed list
    return p3_mapped(spark, sf_dir).where(F.col("type_id").isNotNull()).join(labels, "value", "left_anti").select("src", "rec_id", "type_id")


#: Fields of entities that name somebody.
ORGANISATIONS, PERSONS = ("issuer", "supplier", "employer"), ("full_name", "beneficiary", "contact_person")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, kind, root): every spelling with the group it belongs to."""
    kind = F.when(F.col("field_name").isin(*ORGANISATIONS), "organisation").when(F.col("field_name").isin(*PERSONS), "person")
    return name_variants.link_spellings(table(spark, sf_dir, "entities").select("value", kind.alias("kind")).where("kind is not null"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.all_pairs(p4_groups(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        confusables.changed_records(table(spark, sf_dir, src), column, "id").select(F.lit(src).alias("src"), "rec_id")
        for src, column in (("saved_rules", "query"), ("quarantine", "ai_proposed_name"))
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "saved_rules").select(F.col("query").alias("v")).unionByName(table(spark, sf_dir, "quarantine").select(F.col("ai_proposed_name").alias("v")))
    return confusables.lookalike_groups(values, "v")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.scan_noise(table(spark, sf_dir, "extract_inputs"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(input_id, text): every scanned text as continuous paragraphs."""
    return scan_repair.repair(table(spark, sf_dir, "extract_inputs"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, share): documents in which most words of an item stand close together, in any order."""
    return leakage.find_near(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, share, mean_pmi, spam): the coherence of every document."""
    return spam.incoherent_pages(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_pages(spark, sf_dir).where("spam").select("doc_id")


P8_FOUND_SQL = """
with d as (
  select doc_id, regexp_extract_all(strip_accents(nfc_normalize(lower(text))), '[\\p{L}\\p{N}]+') as w from documents where text is not null
), i as (
  select item_id, regexp_extract_all(strip_accents(nfc_normalize(lower(text))), '[\\p{L}\\p{N}]+') as w from eval_items
), dg as (
  select distinct doc_id, hash(w[k:k+11]) as h, w[k:k+11] as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12)
), ig as (
  select distinct item_id, hash(w[k:k+11]) as h, w[k:k+11] as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12)
)
select distinct doc_id, item_id from dg join ig on dg.h = ig.h and dg.g = ig.g
"""


P8_NEAR_SQL = """
with d as (
  select doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as term from (select doc_id, regexp_extract_all(strip_accents(nfc_normalize(lower(text))), '[\\p{L}\\p{N}]+') as w from documents where text is not null)
), i as (
  select item_id, regexp_extract_all(strip_accents(nfc_normalize(lower(text))), '[\\p{L}\\p{N}]+') as w from eval_items
), t as (select distinct item_id, unnest(w) as term from i), s as (
  select item_id, len(w) as size, len(list_distinct(w)) as terms from i
), occ as (select d.doc_id, t.item_id, d.pos, d.term from d join t using (term)), c as (
  select doc_id, item_id, size, terms from occ join s using (item_id) group by all having 5 * count(distinct term) >= 4 * terms
), near as (
  select c.doc_id, c.item_id, c.terms, a.pos, count(distinct b.term) as m from c join occ a using (doc_id, item_id) join occ b on b.doc_id = c.doc_id and b.item_id = c.item_id and b.pos >= a.pos and b.pos < a.pos + 2 * c.size group by all
)
select doc_id, item_id, max(m) / terms as share from near group by doc_id, item_id, terms having 5 * max(m) >= 4 * terms
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_residue": p2_residue,
        "p3_found": p3_found,
        "p3_mapped": p3_mapped,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_found": p6_found,
        "p6_repaired": p6_repaired,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p8_near": p8_near,
        "p9_found": p9_found,
        "p9_pages": p9_pages,
    }


def oracle_sql() -> dict[str, str]:
    return {"p8_found": P8_FOUND_SQL, "p8_near": P8_NEAR_SQL}
