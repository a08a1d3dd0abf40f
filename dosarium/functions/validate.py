"""Strict reading of a model's JSON answers.

Spark's own JSON functions accept trailing text and single quotes, so the text
goes through ``json.loads`` in an Arrow UDF. A row is never lost: what is wrong
with it stands in ``error``, and everything else of it is null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import MOST_SUMMARY

#: Answers asked for again after an invalid one.
REPAIRS = 2
# Fixed value: what a refusal for too many calls says.
TOO_MANY = "429"

ENTITY = T.StructType([T.StructField("field_name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("reasoning", T.StringType())])
EXTRACTION = T.StructType(
    [T.StructField("document_type", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("suggested_filename", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("error", T.StringType())]
)
DECISION = T.StructType([T.StructField("status", T.StringType()), T.StructField("suggested_name", T.StringType()), T.StructField("suggested_folder", T.StringType()), T.StructField("error", T.StringType())])
RULE = T.StructType([T.StructField("category", T.StringType()), T.StructField("folder_structure", T.StringType()), T.StructField("naming_convention", T.StringType()), T.StructField("error", T.StringType())])


def unfence(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        start = text.index("\n") + 1  # a fence without a line break is no answer
        text = text[start:]
        if text.rstrip().endswith("```"):
            text = text.rstrip()[:-3]
    return text


def rate_limited(message: Column) -> Column:
    """Whether an error says that there were too many calls."""
    return F.coalesce(message.contains(TOO_MANY), F.lit(False))


def summary_fits(summary: Column) -> Column:
    return F.length(summary) <= MOST_SUMMARY


def retried(call: Callable[[str], str], attempts: int = 3, wait: float = 0.0) -> Callable[[str], str]:
    """``call``, which is tried ``attempts`` times, ``wait`` seconds apart, where it is refused for too many calls."""

    def run(value: str) -> str:
        import time

        for i in range(attempts):
            try:
                return call(value)
            except Exception as e:  # noqa: BLE001 - the model is foreign code
                if TOO_MANY not in str(e) or i == attempts - 1:
                    raise
                time.sleep(wait)
        raise AssertionError

    return run


def _text(value: object, field: str) -> str:
    if not isinstance(value, str):
        raise ValueError(f"{field}: not a text")
    return value


def _number(value: object) -> float:
    """Numbers, numeric texts and truth values count; NaN and what lies outside 0 to 1 is refused, not clamped."""
    if isinstance(value, str):
        value = float(value)
    if not isinstance(value, int | float):
        raise ValueError("confidence: not a number")
    if math.isnan(value) or not 0 <= value <= 1:
        raise ValueError("confidence: not from 0 to 1")
    return float(value)


def _object(text: str | None) -> dict:
    found = json.loads(unfence(text or ""))
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def read_extraction(text: str | None) -> tuple:
    found = _object(text)
    summary = _text(found.get("summary", ""), "summary")
    if len(summary) > MOST_SUMMARY:
        raise ValueError("summary: too long")
    entities = found.get("entities", [])
    if not isinstance(entities, list):
        raise ValueError("entities: not a list")
    rows = []
    for e in entities:
        if not isinstance(e, dict) or "field_name" not in e or "value" not in e:
            raise ValueError("entity: field_name and value are needed")
        value = e["value"] if isinstance(e["value"], str) or e["value"] is None else json.dumps(e["value"], ensure_ascii=False, sort_keys=True)
        rows.append((_text(e["field_name"], "field_name"), value, _number(e.get("confidence", 1.0)), _text(e.get("reasoning", ""), "reasoning")))
    return _text(found.get("document_type", "unknown"), "document_type"), summary, _text(found.get("suggested_filename", ""), "suggested_filename"), rows, None


def read_decision(text: str | None) -> tuple:
    found = _object(text)
    if found.get("status") not in ("move", "quarantine"):
        raise ValueError("status: neither move nor quarantine")
    name, folder = (found.get(k) if found.get(k) is None else _text(found[k], k) for k in ("suggested_name", "suggested_folder"))
    if name:
        name = "".join("_" if c in '<>:"/\\|?*' else c for c in name)
    return found["status"], name, folder, None


def read_rule(text: str | None) -> tuple:
    found = _object(text)
    return _text(found.get("category"), "category"), _text(found.get("folder_structure"), "folder_structure"), _text(found.get("naming_convention", "{original_filename}"), "naming_convention"), None


def _safe(read: Callable[[str | None], tuple], width: int) -> Callable[[str | None], tuple]:
    def run(text: str | None) -> tuple:
        try:
            return read(text)
        except (ValueError, TypeError, AttributeError, RecursionError) as e:
            return (*[None] * (width - 1), str(e)[:300] or type(e).__name__)

    return run


def _column(read: Callable[[str | None], tuple], schema: T.StructType) -> Callable[[Column], Column]:
    safe = _safe(read, len(schema))

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([safe(t) for t in texts], columns=schema.names)

    return run


parse_extraction = _column(read_extraction, EXTRACTION)
parse_decision = _column(read_decision, DECISION)
parse_rule = _column(read_rule, RULE)


def ask(model: Callable[[str], str], prompts: Column, schema: T.StructType, repairs: int = REPAIRS, attempts: int = 3, wait: float = 0.0) -> Column:
    """The validated answers of an injected model, as ``schema``. An invalid answer is asked for again with the
    error named; a refusal for too many calls (429) is tried ``attempts`` times, ``wait`` seconds apart."""
    read = {id(EXTRACTION): read_extraction, id(DECISION): read_decision, id(RULE): read_rule}[id(schema)]
    width, names = len(schema), schema.names

    call = retried(model, attempts, wait)

    def one(text: str | None) -> tuple:
        said, error = text or "", ""
        for _ in range(repairs + 1):
            try:
                return read(call(said))
            except Exception as e:  # noqa: BLE001 - a row's error stays with the row
                error = str(e)[:300] or type(e).__name__
                said = f"{text or ''}\n\nInvalid answer: {error}"
        return (*[None] * (width - 1), error)

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=names)

    return run.asNondeterministic()(prompts)
