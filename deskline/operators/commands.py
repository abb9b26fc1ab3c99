"""Command, envelope and payload operators.

Messages and payloads arrive as JSON text columns; everything is parsed with ``from_json`` /
``get_json_object`` under explicit schemas, row-locally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskline.constants import COMMAND_PREFIXES, NO_RESPONSE, PDF_CONTENT_TYPE
from deskline.functions import json_valid, parse_iso, strip_json_ws, strip_ws
from deskline.sources.schemas import TICKET_FEED, TICKET_STAMPS

ENVELOPE_TICKET = T.ArrayType(TICKET_FEED).simpleString()  # the whole ticket, stamps as text
ATTACHMENTS = "array<struct<contentType:string,contentUrl:string>>"
UPLOAD_SCHEMA = f"struct<attachments:{ATTACHMENTS},value:struct<attachments:{ATTACHMENTS}>>"


def unwrap_envelope(df: DataFrame, body: str = "body", field: str = "my_ticket", keys: Sequence[str] = ("event_id",),
                    item_schema: str = ENVELOPE_TICKET) -> tuple[DataFrame, DataFrame]:
    """``{"my_ticket": [...]}`` -> one row per ticket; a missing key or a non-list value is
    malformed and goes to the second frame (an empty list is fine and yields no rows), and so does a body that
    is not one whole JSON value, text behind it included. Tickets come with
    all fields of the ticket feed, stamps parsed by B1."""
    parsed = F.when(json_valid(body), F.from_json(F.col(body), f"struct<{field}:{item_schema}>")[field])
    x = df.select(*keys, body, parsed.alias("_items"))
    bad = x.filter(F.col("_items").isNull()).select(*keys, body)
    ok = (x.filter(F.col("_items").isNotNull()).select(*keys, F.posexplode("_items").alias("pos", "t"))
          .select(*keys, F.col("pos").cast("int"), "t.*"))
    ok = ok.withColumns({c: parse_iso(c).cast("timestamp_ntz") for c in TICKET_STAMPS if c in ok.columns})
    return ok, bad


def unwrap_items(df: DataFrame, body: str = "body", field: str = "my_ticket", keys: Sequence[str] = ("event_id",),
                 schema: T.StructType = TICKET_FEED, stamps: Sequence[str] = TICKET_STAMPS) -> tuple[DataFrame, DataFrame]:
    """I6 item by item: ``(items, rejects)``; a bad item is turned away, not its neighbours.

    ``items``: ``keys``, ``pos`` and the fields of ``schema``. ``rejects``: ``keys``, ``pos`` (null for a whole body),
    ``reason`` and ``record`` (the item or body as text). Reasons: ``body`` (not one whole JSON value, null too),
    ``list`` (no list under ``field``), ``object`` (an item of another kind), ``fields`` (a value that does not fit
    its field, an id that is no whole number too), ``id`` (none). An empty list has no rows in either. Fields that
    ``schema`` does not name are ignored; null stamps and unreadable ones are null (B1)."""
    value = F.when(json_valid(body), F.try_parse_json(F.col(body)))
    x = df.select(*keys, F.col(body).alias("_body"), value.alias("_v"))
    x = x.withColumn("_list", F.try_variant_get("_v", f"$.{field}", "array<variant>"))
    whole = x.filter(F.col("_list").isNull()).select(
        *keys, F.lit(None).cast("int").alias("pos"), F.when(F.col("_v").isNull(), F.lit("body")).otherwise(F.lit("list")).alias("reason"),
        F.col("_body").alias("record"))
    each = x.select(*keys, F.posexplode("_list").alias("pos", "_item"))
    corrupt = "_corrupt"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    each = each.withColumn("record", F.coalesce(F.to_json("_item"), F.lit("null")))
    each = each.withColumn("_r", F.from_json("record", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    reason = (F.when(~F.coalesce(F.schema_of_variant("_item").startswith("OBJECT"), F.lit(False)), F.lit("object"))
              .when(F.col(f"_r.{corrupt}").isNotNull(), F.lit("fields"))
              .when(F.col("_r.id").isNull(), F.lit("id")))
    each = each.withColumn("reason", reason)
    ok = each.filter(F.col("reason").isNull()).select(*keys, F.col("pos").cast("int").alias("pos"), "_r.*").drop(corrupt)
    ok = ok.withColumns({c: parse_iso(c).cast("timestamp_ntz") for c in stamps if c in ok.columns})
    bad = each.filter(F.col("reason").isNotNull()).select(*keys, F.col("pos").cast("int").alias("pos"), "reason", "record")
    return ok, whole.unionByName(bad)


def count_payload(payload) -> Column:
    """A JSON list counts its items, a single object counts 1, anything else is null (reject)."""
    kind = payload_kind(payload)
    return (F.when(kind == "list", F.json_array_length(strip_json_ws(payload)).cast("bigint"))
            .when(kind == "object", F.lit(1).cast("bigint")))


def payload_kind(payload) -> Column:
    """``list``, ``object`` or ``invalid``; a text that is not one whole JSON value is invalid."""
    p = strip_json_ws(payload)
    ok = json_valid(payload)
    return (F.when(ok & p.startswith("["), F.lit("list")).when(ok & p.startswith("{"), F.lit("object"))
            .otherwise(F.lit("invalid")))


def route_commands(df: DataFrame, text: str = "message", user: str = "aad_object_id", service_url: str = "service_url",
                   conversation: str = "conversation_id", prefixes: Sequence[str] = COMMAND_PREFIXES,
                   arg_prefixes: Sequence[str] | None = None) -> DataFrame:
    """Trim + lower the text, check required fields, dispatch on the first matching prefix.

    ``command`` is the matched prefix, 'unknown' when none matches, 'invalid' when a required field
    is missing or empty. ``args`` is the rest of the lowered text after the prefix (trimmed), for
    the prefixes in ``arg_prefixes`` (default: the first, the free-text question).
    """
    arg_prefixes = list(arg_prefixes if arg_prefixes is not None else prefixes[:1])
    cmd = F.lower(strip_ws(F.coalesce(F.col(text), F.lit(""))))
    missing = (cmd == "")
    for c in (user, service_url, conversation):
        missing = missing | F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.lit(""))
    route = F.lit("unknown")
    args = F.lit(None).cast("string")
    for p in reversed(list(prefixes)):
        route = F.when(cmd.startswith(p), F.lit(p)).otherwise(route)
    for p in arg_prefixes:
        args = F.when(route == p, strip_ws(F.substr(cmd, F.lit(len(p) + 1)))).otherwise(args)
    return df.select("*", cmd.alias("command_text"),
                     F.when(missing, F.lit("invalid")).otherwise(route).alias("command"),
                     F.when(missing, F.lit(None)).otherwise(args).alias("args"))


def command_log(routed: DataFrame, user: str = "aad_object_id", response: str = "response", tickets: str = "tickets",
                question: str = COMMAND_PREFIXES[0], next_ticket: str = COMMAND_PREFIXES[1],
                no_response: str = NO_RESPONSE) -> DataFrame:
    """I8: audit rows (aadObjectId, command, command_data JSON, result_data JSON) for the two logged
    commands, the free-text question and the next ticket; no other command is logged.

    ``command_data`` is ``{"message": args}`` for the question, ``{"command": name}`` for the next ticket.
    ``result_data`` holds what was answered: ``{"response": text}`` from the column ``response`` (null:
    ``no_response``), or ``{"tickets": [...]}`` from the JSON list in the column ``tickets`` (null: empty).
    """
    asked = F.col("command") == question
    result = (F.when(asked, F.to_json(F.struct(F.coalesce(F.col(response), F.lit(no_response)).alias("response"))))
              .otherwise(F.concat(F.lit('{"tickets":'), F.coalesce(F.col(tickets), F.lit("[]")), F.lit("}"))))
    data = F.when(F.col("args").isNotNull(), F.to_json(F.struct(F.col("args").alias("message")))) \
            .otherwise(F.to_json(F.struct(F.col("command").alias("command"))))
    return (routed.filter(F.col("command").isin(question, next_ticket))
            .select(F.col(user).alias("aadObjectId"), "command", data.alias("command_data"),
                    result.alias("result_data")))


def valid_uploads(df: DataFrame, payload: str = "payload", keys: Sequence[str] = ("event_id",),
                  content_type: str = PDF_CONTENT_TYPE) -> DataFrame:
    """Accept exactly one attachment of ``content_type``, looked up at the root and, when the
    root list is missing or empty, under ``value``. A payload that is not one whole JSON value has none."""
    p = F.when(json_valid(payload), F.from_json(F.col(payload), UPLOAD_SCHEMA))
    root, nested = p["attachments"], p["value"]["attachments"]
    atts = (F.when(F.coalesce(F.size(root), F.lit(0)) > 0, root)
            .otherwise(F.coalesce(nested, F.array().cast(ATTACHMENTS))))
    x = df.select(*keys, atts.alias("_a"))
    n = F.size("_a")
    ok = (n == 1) & (F.element_at("_a", 1)["contentType"] == content_type)
    return x.select(*keys, n.cast("int").alias("n_attachments"), F.coalesce(ok, F.lit(False)).alias("ok"),
                    F.when(ok, F.element_at("_a", 1)["contentUrl"]).alias("content_url"))
