"""Tolerant JSON extraction from model answers, as column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """The JSON value that the whole text is; null if anything follows it.

    The parser stops behind the first value. Inside brackets and inside braces
    what follows is in its way, and no text can close both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(listed.isNotNull(), F.try_variant_get(named, "$.v", "variant"))


def _of_kind(text: Column, prefix: str) -> Column:
    parsed = parse(text)
    return F.when(F.schema_of_variant(parsed).startswith(prefix), parsed)


def extract_object(text: Column) -> Column:
    """The JSON object that a text is, or holds from its first { to its last }; null if none."""
    return F.coalesce(_of_kind(text, "OBJECT"), _of_kind(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "OBJECT"))


def extract_array(text: Column) -> Column:
    """The JSON array that a text is, or holds from its first [ to its last ]; null if none."""
    return F.coalesce(_of_kind(text, "ARRAY"), _of_kind(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "ARRAY"))


def get(variant: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(variant, path, kind)


def with_fallback(value: Column, fallback: Column) -> Column:
    return F.coalesce(value, fallback)


def confidence(variant: Column, path: str = "$.confidence") -> Column:
    """A number, or text that is one; null otherwise."""
    return get(variant, path, "string").try_cast("double")


def strict_number(variant: Column, path: str) -> Column:
    """A value that is a number or boolean in the JSON itself; text never counts."""
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.when(kind == "STRING", None).otherwise(F.coalesce(get(variant, path, "double"), get(variant, path, "boolean").cast("double")))


def selection_index(text: Column, size: Column) -> Column:
    """A 1-based choice in a model's answer, 1 by default, clamped to the list's size."""
    chosen = get(extract_object(text), "$.index", "int")
    return F.greatest(F.lit(1), F.least(F.coalesce(chosen, F.lit(1)), size))


def strings(variant: Column) -> Column:
    """A JSON array's elements as strings."""
    return F.try_variant_get(variant, "$", "array<string>")


def has_precision(report: Column) -> Column:
    """Whether any metrics section of a report holds a precision."""
    sections = ("judge_metrics_overall", "judge_metrics", "visual_veracity_ai_detection", "visual_veracity_ai_detection_all")
    return F.exists(F.array(*[get(report, f"$.{s}.metrics.precision", "string") for s in sections]), lambda x: x.isNotNull())
