"""Registered ingest, command and stamp queries (I6, I8, I9, I12, I14, B1, B2) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskline import constants as K
from deskline.functions import display_text, parse_iso, parse_strict_z
from deskline.functions.stamps import ISO_GUARD, STRICT_Z
from deskline.operators import commands as C
from deskline.operators.tickets import exclude_queues
from deskline.plans.registry import register
from deskline.plans.sqlbits import EXCLUDE_QUEUES, display
from deskline.session import ensure_session
from deskline.sources.fixtures import view, with_views

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _view(spark, sf_dir, name):
    ensure_session(spark)
    return view(spark, sf_dir, name)


@register("parse_stamps", with_views(["stamps"], f"""
SELECT event_id, txt,
       CASE WHEN regexp_full_match(regexp_replace(txt, 'Z+$', ''), '{ISO_GUARD}')
            THEN TRY_CAST(regexp_replace(txt, 'Z+$', '') AS TIMESTAMP) END AS iso_ts,
       CASE WHEN regexp_full_match(txt, '{STRICT_Z}')
            THEN try(make_timestamp(CAST(regexp_extract(txt, '{STRICT_Z}', 1) AS BIGINT), CAST(regexp_extract(txt, '{STRICT_Z}', 2) AS BIGINT),
                                    CAST(regexp_extract(txt, '{STRICT_Z}', 3) AS BIGINT), CAST(regexp_extract(txt, '{STRICT_Z}', 4) AS BIGINT),
                                    CAST(regexp_extract(txt, '{STRICT_Z}', 5) AS BIGINT),
                                    CAST(regexp_extract(txt, '{STRICT_Z}', 6) AS DOUBLE) + coalesce(TRY_CAST('0' || regexp_extract(txt, '{STRICT_Z}', 7) AS DOUBLE), 0))) END AS strict_ts
FROM stamps
"""))
def parse_stamps(spark, sf_dir):
    """B1 (lenient ISO with guard) and B2 (strict ...Z) on a column of stamp texts."""
    s = _view(spark, sf_dir, "stamps")
    return s.select("event_id", "txt", parse_iso("txt").cast("timestamp_ntz").alias("iso_ts"),
                    parse_strict_z("txt").cast("timestamp_ntz").alias("strict_ts"))


@register("display_stamps", with_views(["stamps"], f"""
, p AS (SELECT event_id, txt, CASE WHEN txt ~ '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' THEN TRY_CAST(regexp_replace(txt, 'Z+$', '') AS TIMESTAMP) END AS t FROM stamps)
SELECT event_id, CASE WHEN coalesce(txt, '') = '' THEN 'N/A' WHEN t IS NULL THEN 'Invalid Date' ELSE {display('t')} END AS shown FROM p
"""))
def display_stamps(spark, sf_dir):
    """B12 on stamp texts: 'N/A' without one, 'Invalid Date' for what is none."""
    return _view(spark, sf_dir, "stamps").select("event_id", display_text("txt").alias("shown"))


_ENV = """
, env AS (SELECT event_id, body, json_extract(body, '$.my_ticket') AS mt FROM ticket_envelopes)
"""


@register("unwrap_tickets", with_views(["ticket_envelopes"], _ENV + f"""
, items AS (SELECT event_id, from_json(mt, '[{{"id":"BIGINT","queueID":"BIGINT","title":"VARCHAR","description":"VARCHAR","companyID":"BIGINT","status":"INTEGER","priority":"INTEGER","createDate":"VARCHAR","resolvedDueDateTime":"VARCHAR"}}]') AS a
            FROM env WHERE json_type(mt) = 'ARRAY')
SELECT event_id, CAST(i - 1 AS INT) AS pos, t.id AS id, t.queueID AS queueID, t.title AS title, t.description AS description, t.companyID AS companyID, t.status AS status, t.priority AS priority,
       TRY_CAST(rtrim(t.createDate, 'Z') AS TIMESTAMP) AS createDate, TRY_CAST(rtrim(t.resolvedDueDateTime, 'Z') AS TIMESTAMP) AS resolvedDueDateTime
FROM (SELECT event_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM items)
WHERE {EXCLUDE_QUEUES.replace('queueID', 't.queueID')}
"""))
def unwrap_tickets(spark, sf_dir):
    """I6 + T10: tickets from the envelopes, excluded queues dropped."""
    ok, _ = C.unwrap_envelope(_view(spark, sf_dir, "ticket_envelopes"))
    return exclude_queues(ok).select("event_id", "pos", "id", "queueID", "title", "description", "companyID", "status",
                                     "priority", "createDate", "resolvedDueDateTime")


@register("envelope_rejects", with_views(["ticket_envelopes"], _ENV + """
SELECT event_id, body FROM env WHERE mt IS NULL OR json_type(mt) <> 'ARRAY'
"""))
def envelope_rejects(spark, sf_dir):
    """Envelopes without a ticket list (kept for inspection)."""
    return C.unwrap_envelope(_view(spark, sf_dir, "ticket_envelopes"))[1]


@register("count_payload", with_views(["payload_texts"], """
, j AS (SELECT event_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM payload_texts)
SELECT event_id, CASE json_type(p) WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'invalid' END AS payload_kind,
       CAST(CASE json_type(p) WHEN 'ARRAY' THEN json_array_length(p) WHEN 'OBJECT' THEN 1 END AS BIGINT) AS ticket_count
FROM j
"""))
def count_payload(spark, sf_dir):
    """List -> length, object -> 1, anything else (broken JSON too) -> null (reject)."""
    e = _view(spark, sf_dir, "payload_texts")
    return e.select("event_id", C.payload_kind("payload").alias("payload_kind"),
                    C.count_payload("payload").alias("ticket_count"))


def _route_sql() -> str:
    cmd = f"lower(trim(coalesce(message, ''), {_WS}))"
    route = "CASE " + " ".join(f"WHEN starts_with(cmd, '{p}') THEN '{p}'" for p in K.COMMAND_PREFIXES) + " ELSE 'unknown' END"
    p0 = K.COMMAND_PREFIXES[0]
    return f"""
, c1 AS (SELECT *, {cmd} AS cmd FROM command_messages)
, routed AS (SELECT event_id, message, aad_object_id, service_url, conversation_id, cmd AS command_text,
                    CASE WHEN cmd = '' OR coalesce(aad_object_id, '') = '' OR coalesce(service_url, '') = ''
                              OR coalesce(conversation_id, '') = '' THEN 'invalid' ELSE {route} END AS command
             FROM c1)
, routed2 AS (SELECT *, CASE WHEN command = '{p0}' THEN trim(substring(command_text, {len(p0) + 1}), {_WS}) END AS args FROM routed)
"""


@register("route_commands", with_views(["command_messages"], _route_sql() + "SELECT * FROM routed2"))
def route_commands(spark, sf_dir):
    """I9."""
    return C.route_commands(_view(spark, sf_dir, "command_messages"))


@register("command_log", with_views(["command_messages", "command_results"], _route_sql() + """
SELECT aad_object_id AS aadObjectId, command,
       CASE command WHEN 'askbot' THEN to_json({'message': args}) ELSE to_json({'command': 'getnextticket'}) END :: VARCHAR AS command_data,
       CASE command WHEN 'askbot' THEN to_json({'response': coalesce(response, 'No response received.')}) :: VARCHAR
            ELSE '{"tickets":' || coalesce(tickets, '[]') || '}' END AS result_data
FROM routed2 JOIN command_results USING (event_id) WHERE command IN ('askbot', 'getnextticket')
"""))
def command_log(spark, sf_dir):
    """I8: audit rows of the questions and next-ticket commands with what was answered."""
    routed = C.route_commands(_view(spark, sf_dir, "command_messages"))
    return C.command_log(routed.join(_view(spark, sf_dir, "command_results"), "event_id"))


@register("valid_uploads", with_views(["uploads"], """
, a AS (SELECT event_id,
               CASE WHEN json_array_length(json_extract(payload, '$.attachments')) > 0 THEN json_extract(payload, '$.attachments')
                    ELSE coalesce(json_extract(payload, '$.value.attachments'), '[]') END AS atts
        FROM uploads)
SELECT event_id, CAST(json_array_length(atts) AS INT) AS n_attachments,
       coalesce(json_array_length(atts) = 1 AND json_extract_string(atts, '$[0].contentType') = 'application/pdf', false) AS ok,
       CASE WHEN json_array_length(atts) = 1 AND json_extract_string(atts, '$[0].contentType') = 'application/pdf'
            THEN json_extract_string(atts, '$[0].contentUrl') END AS content_url
FROM a
"""))
def valid_uploads(spark, sf_dir):
    """I12."""
    return C.valid_uploads(_view(spark, sf_dir, "uploads"))


@register("unwrap_ticket_items", with_views(["mixed_envelopes"], """
, b AS (SELECT event_id, json_valid(body) AS good, CASE WHEN json_valid(body) THEN json_extract(body, '$.my_ticket') END AS listed FROM mixed_envelopes)
, items AS (SELECT event_id, listed, CAST(unnest(range(CAST(json_array_length(listed) AS BIGINT))) AS INT) AS pos FROM b WHERE json_type(listed) = 'ARRAY')
, item AS (SELECT event_id, pos, json_extract(listed, '$[' || pos || ']') AS v FROM items)
SELECT event_id, CAST(NULL AS INT) AS pos, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS queueID, CASE WHEN good THEN 'list' ELSE 'body' END AS reason
FROM b WHERE NOT good OR coalesce(json_type(listed), '') <> 'ARRAY'
UNION ALL
SELECT event_id, pos, CASE WHEN json_type(v, '$.id') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(v, '$.id') AS BIGINT) END,
       CASE WHEN json_type(v, '$.id') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(v, '$.queueID') AS BIGINT) END,
       CASE WHEN json_type(v) <> 'OBJECT' THEN 'object' WHEN json_type(v, '$.id') IS NULL THEN 'id'
            WHEN json_type(v, '$.id') NOT IN ('UBIGINT', 'BIGINT') THEN 'fields' END
FROM item
"""))
def unwrap_ticket_items(spark, sf_dir):
    """I6 strictly: every item of every envelope, with the reason why it (or the whole body) was turned away."""
    ok, bad = C.unwrap_items(_view(spark, sf_dir, "mixed_envelopes"))
    none = F.lit(None).cast("bigint")
    return ok.select("event_id", "pos", "id", "queueID", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("event_id", "pos", none.alias("id"), none.alias("queueID"), "reason"))
