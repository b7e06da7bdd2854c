"""Recovering structured answers from model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import trimmed

# ---- fixed values -----------------------------------------------------------
FENCED = "```(?:json)?\\s*([\\s\\S]*?)```"
BRACED = "\\{[\\s\\S]*\\}"
ENVELOPE_KEYS = ["invoice", "document", "us_document", "sa", "so"]
SIDE_KEYS = ["confidence", "metadata", "validation", "document_id"]
# -----------------------------------------------------------------------------


def recovered(text: Column) -> Column:
    """The JSON in a response as a variant: the whole text, a fenced block, the outermost braces, or {}."""
    def parsed(candidate: Column) -> Column:
        return F.try_parse_json(F.when(candidate != "", candidate))

    return F.coalesce(parsed(trimmed(text)), parsed(trimmed(F.regexp_extract(text, FENCED, 1))),
                      parsed(F.regexp_extract(text, BRACED, 0)), F.parse_json(F.lit("{}")))


def answer_text(response: Column) -> Column:
    """The text of a response envelope: its own text, else the last message that has some."""
    body = F.try_parse_json(response)
    own = F.try_variant_get(body, "$.text", "string")
    messages = F.reverse(F.coalesce(F.try_variant_get(body, "$.messages", "array<variant>"), F.array().cast("array<variant>")))

    def spoken(message: Column) -> Column:
        parts = F.try_variant_get(message, "$.content", "array<struct<type:string,text:string>>")
        first = F.get(F.filter(parts, lambda p: p["type"] == "text"), F.lit(0))
        plain = F.when(parts.isNull(), F.try_variant_get(message, "$.content", "string"))
        return F.when(plain != "", plain).when(first.isNotNull(), F.coalesce(first["text"], F.lit("")))

    said = F.get(F.filter(F.transform(messages, spoken), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(own, said, F.lit(""))


def envelope_document(payload: Column) -> Column:
    """The document inside a payload (JSON text) as map<string,variant>.

    The first of the known envelope keys that holds an object; without one, the payload itself
    less the keys that travel beside a document.
    """
    body = F.try_parse_json(payload)
    inside = [F.try_variant_get(body, f"$.{key}", "map<string,variant>") for key in ENVELOPE_KEYS]
    whole = F.map_filter(F.try_variant_get(body, "$", "map<string,variant>"),
                         lambda k, _: ~k.isin(*SIDE_KEYS, *ENVELOPE_KEYS))
    return F.coalesce(*inside, whole)


def document_type(document: Column, default: Column) -> Column:
    named = F.map_contains_key(document, "document_type")
    return F.when(named, F.try_variant_get(document["document_type"], "$", "string")).otherwise(default)
