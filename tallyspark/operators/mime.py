"""Attachments inside nested mail payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.values import mail_date
from tallyspark.operators.intake import is_inline

_HEADERS = "array<struct<name:string,value:string>>"
#: What one part says; the parts in it stay as they are until their level is read.
_NODE = f"struct<filename:string,mimeType:string,body:struct<attachmentId:string,size:bigint>,headers:{_HEADERS},parts:array<variant>>"
_FOUND = "array<struct<path:array<int>,node:struct<filename:string,attachment_id:string,mime_type:string,size_bytes:bigint,headers:array<struct<name:string,value:string>>>>>"


def _node(part: Column) -> Column:
    return F.try_variant_get(part, "$", _NODE)


def _attachments(root: Column, payload: Column) -> Column:
    """(path, node) of the attachments of a message in reading order, to any depth.

    One nesting level is unfolded per step, and a payload nests no deeper than the word for its parts occurs in it. Every part is
    read once, and only what an attachment says is carried on.
    """
    steps = F.sequence(F.lit(0), F.coalesce(F.regexp_count(payload, F.lit('"parts"')), F.lit(0)))

    def children(p: Column) -> Column:
        inner = F.coalesce(p.node.parts, F.array().cast("array<variant>"))
        return F.transform(inner, lambda child, at: F.struct(F.concat(p.path, F.array(at)).alias("path"), _node(child).alias("node")))

    def attached(level: Column) -> Column:
        having = F.filter(level, lambda p: (p.node.filename != "") & (p.node.body.attachmentId != ""))
        return F.transform(having, lambda p: F.struct(p.path.alias("path"), F.struct(
            p.node.filename.alias("filename"), p.node.body.attachmentId.alias("attachment_id"), p.node.mimeType.alias("mime_type"),
            p.node.body.size.alias("size_bytes"), p.node.headers.alias("headers")).alias("node")))

    def deeper(seen: Column, _step: Column) -> Column:
        return F.struct(F.concat(seen.found, attached(seen.level)).alias("found"), F.flatten(F.transform(seen.level, children)).alias("level"))

    level = F.array(F.struct(F.array().cast("array<int>").alias("path"), root.alias("node")))
    start = F.struct(F.array().cast(_FOUND).alias("found"), level.alias("level"))
    found = F.aggregate(steps, start, deeper, lambda seen: seen.found)
    return F.array_sort(found, lambda a, b: F.when(a.path < b.path, -1).when(a.path > b.path, 1).otherwise(0))


def _header(headers: Column, name: str) -> Column:
    """The first header of that name in any case, empty if there is none."""
    mine = F.filter(headers, lambda h: F.lower(F.coalesce(h["name"], F.lit(""))) == name)
    return F.coalesce(F.get(mine, F.lit(0))["value"], F.lit(""))


def attachments(messages: DataFrame) -> DataFrame:
    """Attachment parts of (message_id, payload JSON text[, thread_id]), numbered in reading order, with their message's headers.

    A message is read once and its attachments are numbered where it is, so nothing is shuffled.
    """
    thread = F.col("thread_id") if "thread_id" in messages.columns else F.lit(None).cast("string")
    none = F.array().cast(_HEADERS)
    opened = messages.select("message_id", thread.alias("thread_id"), "payload", _node(F.try_parse_json("payload")).alias("root"))
    headed = opened.select("message_id", "thread_id", "payload", "root", F.coalesce("root.headers", none).alias("headers"))
    walked = headed.select(
        "message_id", "thread_id", _header(F.col("headers"), "from").alias("from_address"), _header(F.col("headers"), "subject").alias("subject"),
        _header(F.col("headers"), "date").alias("date"), _attachments(F.col("root"), F.col("payload")).alias("found"))
    dated = walked.select("message_id", "thread_id", "from_address", "subject", F.coalesce(mail_date(F.col("date")), F.lit("")).alias("received_at"), "found")
    # outer, as a filter on the size of the list would be moved below and walk every message twice
    parts = dated.select("message_id", "thread_id", "from_address", "subject", "received_at", F.posexplode_outer("found").alias("part_index", "p"))
    kind = F.col("p.node.mime_type")
    return parts.filter(F.col("p").isNotNull()).select(
        "message_id", "thread_id", "from_address", "subject", "received_at", F.col("p.node.filename").alias("filename"),
        F.col("p.node.attachment_id").alias("attachment_id"), F.when(F.coalesce(kind, F.lit("")) == "", "application/octet-stream").otherwise(kind).alias("mime_type"),
        F.coalesce("p.node.size_bytes", F.lit(0)).alias("size_bytes"), is_inline(F.coalesce("p.node.headers", none)).alias("is_inline"), "part_index")
