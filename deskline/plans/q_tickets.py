"""Registered ticket queries (T1-T14) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskline import constants as K
from deskline.operators import tickets as T
from deskline.plans.registry import register
from deskline.plans.sqlbits import (
    DESK, EXCLUDE_QUEUES, case_map, display, hours_text, missed_expr, secs, sla_met, weight_expr,
)
from deskline.session import ensure_session
from deskline.sources.fixtures import AS_OF_DESK, view, with_views

URL = T.DEFAULT_URL


def _tickets(spark, sf_dir):
    ensure_session(spark)
    return view(spark, sf_dir, "tickets")


def _weighted(spark, sf_dir, cols=("id", "companyID", "assignedResourceID", "title", "priority", "status")):
    w = T.ticket_weight(T.exclude_queues(_tickets(spark, sf_dir)), AS_OF_DESK)
    return w.select(*cols, "sla_missed", "weight")


# --- T5-T7, T10, T14: the next-ticket job -------------------------------------------------------
@register("next_ticket_per_company", with_views(["tickets"], f"""
, w AS (SELECT id, companyID, title, {weight_expr()} AS weight, {missed_expr()} AS sla_missed
        FROM tickets WHERE {EXCLUDE_QUEUES})
, r AS (SELECT *, row_number() OVER (PARTITION BY companyID ORDER BY weight DESC, id) AS rn FROM w)
SELECT companyID, id AS ticket_id, title, CAST(weight AS BIGINT) AS points, CAST(sla_missed AS BIGINT) AS sla_missed,
       '{{"tickets":[{{"ticket_id":' || CAST(id AS VARCHAR) || ',"title":"' || title || '","points":' || CAST(weight AS VARCHAR) || '}}]}}' AS result_data
FROM r WHERE rn = 1
"""))
def next_ticket_per_company(spark, sf_dir):
    best = T.next_ticket(_weighted(spark, sf_dir), per=["companyID"], n=1)
    return best.select("companyID", F.col("id").alias("ticket_id"), "title", F.col("weight").alias("points"),
                       "sla_missed", T.ticket_digest(best).alias("result_data"))


@register("ticket_weight", with_views(["tickets"], f"""
SELECT id, companyID, priority, status, CAST({missed_expr()} AS BIGINT) AS sla_missed, CAST({weight_expr()} AS BIGINT) AS weight
FROM tickets WHERE {EXCLUDE_QUEUES}
"""))
def ticket_weight(spark, sf_dir):
    return _weighted(spark, sf_dir).select("id", "companyID", "priority", "status", "sla_missed", "weight")


@register("next_ticket_overall", with_views(["tickets"], f"""
SELECT id AS ticket_id, title, CAST({weight_expr()} AS BIGINT) AS points
FROM tickets WHERE {EXCLUDE_QUEUES} ORDER BY {weight_expr()} DESC, id LIMIT 1
"""))
def next_ticket_overall(spark, sf_dir):
    """T7 without a group: the single top ticket (TakeOrderedAndProject)."""
    best = T.next_ticket(_weighted(spark, sf_dir), per=None, n=1)
    return best.select(F.col("id").alias("ticket_id"), "title", F.col("weight").alias("points"))


@register("top3_tickets_per_resource", with_views(["tickets"], f"""
, w AS (SELECT id, assignedResourceID, {weight_expr()} AS weight FROM tickets WHERE {EXCLUDE_QUEUES})
SELECT assignedResourceID, id AS ticket_id, CAST(weight AS BIGINT) AS points,
       CAST(rn AS INT) AS rank_no
FROM (SELECT *, row_number() OVER (PARTITION BY assignedResourceID ORDER BY weight DESC, id) AS rn FROM w) WHERE rn <= 3
"""))
def top3_tickets_per_resource(spark, sf_dir):
    """T7 per user with n > 1 (row_number with a partial WindowGroupLimit before the shuffle)."""
    top = T.next_ticket(_weighted(spark, sf_dir), per=["assignedResourceID"], n=3, rank_col="rank_no")
    return top.select("assignedResourceID", F.col("id").alias("ticket_id"), F.col("weight").alias("points"),
                      F.col("rank_no").cast("int"))


# --- T1-T4, T11, T12 ----------------------------------------------------------------------------
@register("ticket_counts", with_views(["tickets"], """
SELECT CASE g WHEN 7 THEN 'companyID' WHEN 11 THEN 'contactID' WHEN 13 THEN 'issueType' WHEN 14 THEN 'subIssueType' ELSE 'total' END AS dim,
       CAST(CASE g WHEN 7 THEN companyID WHEN 11 THEN contactID WHEN 13 THEN issueType WHEN 14 THEN subIssueType END AS BIGINT) AS value,
       CAST(n AS BIGINT) AS ticket_count
FROM (SELECT companyID, contactID, issueType, subIssueType, count(*) AS n,
             GROUPING(companyID, contactID, issueType, subIssueType) AS g
      FROM tickets GROUP BY GROUPING SETS ((companyID), (contactID), (issueType), (subIssueType), ()))
"""))
def ticket_counts(spark, sf_dir):
    return T.ticket_counts(_tickets(spark, sf_dir))


@register("priority_histogram", with_views(["tickets"], """
SELECT CAST(v.p AS INT) AS priority, CAST(count(t.id) AS BIGINT) AS ticket_count
FROM (VALUES (1), (2), (3), (4)) AS v(p) LEFT JOIN tickets t ON t.priority = v.p
GROUP BY v.p
"""))
def priority_histogram(spark, sf_dir):
    return T.priority_histogram(_tickets(spark, sf_dir))


@register("ticket_summary", with_views(["tickets"], """
SELECT CAST(count(*) AS BIGINT) AS total_tickets,
       CAST(count(*) FILTER (WHERE serviceLevelAgreementHasBeenMet IS TRUE) AS BIGINT) AS sla_met_count,
       round(coalesce(avg((epoch_us(resolvedDateTime) - epoch_us(createDate)) / 3.6e9), 0.0), 6) AS average_resolution_time,
       CAST(count(*) FILTER (WHERE status IS NOT NULL AND status <> 5) AS BIGINT) AS open_tickets
FROM tickets
"""))
def ticket_summary(spark, sf_dir):
    out = T.ticket_summary(_tickets(spark, sf_dir))
    return out.withColumn("average_resolution_time", F.round("average_resolution_time", 6))


@register("open_tickets", with_views(["tickets"], """
SELECT companyID, CAST(count(*) FILTER (WHERE status IS NOT NULL AND status <> 5) AS BIGINT) AS open_tickets
FROM tickets GROUP BY companyID
"""))
def open_tickets(spark, sf_dir):
    return T.open_tickets(_tickets(spark, sf_dir), per=["companyID"])


def _url_sql(col: str = "id") -> str:
    parts = URL.split("{id}")
    out = f"'{parts[0]}'"
    for p in parts[1:]:
        out += f" || CAST({col} AS VARCHAR)" + (f" || '{p}'" if p else "")
    return out


_URL_SQL = _url_sql()


@register("my_tickets", with_views(["tickets"], f"""
SELECT assignedResourceID, id, coalesce(title, 'Untitled') AS title,
       substring(coalesce(description, 'No description available.'), 1, 200) || '...' AS description,
       coalesce(CAST(status AS VARCHAR), 'Unknown') AS status, {_URL_SQL} AS url
FROM tickets
"""))
def my_tickets(spark, sf_dir):
    return T.my_tickets(_tickets(spark, sf_dir), URL)


# --- T8, T13 ------------------------------------------------------------------------------------
def _sla_unnest_sql() -> str:
    parts = []
    for i, (m, d, name) in enumerate(K.SLA_PAIRS):
        sec = f"CASE WHEN {d} IS NOT NULL THEN {secs(f'coalesce({m}, {DESK})', d)} END"
        parts.append(f"""
SELECT id, {i} AS pos, '{name}' AS sla_name, {sla_met(m, d)} AS met,
       {m} IS NULL AND {d} IS NOT NULL AND {d} > {DESK} AS not_yet_due,
       {sec} AS secs, {display(d)} AS due_date,
       CASE WHEN {d} IS NOT NULL AND {m} IS NOT NULL THEN {display(m)} ELSE 'Not completed' END AS met_date
FROM tickets""")
    return " UNION ALL ".join(parts)


_TIME_STATUS = (f"CASE WHEN secs IS NULL THEN 'N/A' WHEN secs >= 0 THEN 'Time Left: ' || {hours_text('secs')} || ' hours' "
                f"ELSE 'Overdue by: ' || {hours_text('secs')} || ' hours' END")
_STATUS_TEXT = "CASE WHEN not_yet_due THEN 'Not Yet Due' WHEN met THEN 'Met' ELSE 'Not Met' END"


@register("sla_timeline", with_views(["tickets"], f"""
, s AS ({_sla_unnest_sql()})
SELECT id, CAST(pos AS INT) AS pos, sla_name, {_STATUS_TEXT} AS status_text,
       CASE WHEN not_yet_due THEN 'default' WHEN met THEN 'good' ELSE 'attention' END AS status_color,
       due_date, met_date, {_TIME_STATUS} AS time_status
FROM s
"""))
def sla_timeline(spark, sf_dir):
    t = T.sla_results(_tickets(spark, sf_dir), AS_OF_DESK)
    return T.sla_timeline(t, AS_OF_DESK)


_PRIO_LABEL = case_map("priority", {k: v[0] for k, v in K.PRIORITY_LABELS.items()}, "'Unknown'")
_PRIO_COLOR = case_map("priority", {k: v[1] for k, v in K.PRIORITY_LABELS.items()}, "'default'")
_STATUS_LABEL = case_map("status", K.STATUS_LABELS, "'Status ID ' || CAST(status AS VARCHAR)")


@register("ticket_detail", with_views(["tickets"], f"""
, s AS ({_sla_unnest_sql()})
, l AS (SELECT id, string_agg(sla_name || ': ' || {_STATUS_TEXT} || ' | ' || due_date || ' | ' || met_date || ' | ' || {_TIME_STATUS}, '; ' ORDER BY pos) AS timeline
        FROM s GROUP BY id)
SELECT t.id, t.title,
       CASE WHEN length(coalesce(description, '')) > 200 THEN substring(description, 1, 200) || '...' ELSE coalesce(description, '') END AS description,
       {_PRIO_LABEL} AS priority_text, {_PRIO_COLOR} AS priority_color, {_STATUS_LABEL} AS status_text,
       l.timeline, {_url_sql('t.id')} AS url
FROM tickets t JOIN l ON l.id = t.id
"""))
def ticket_detail(spark, sf_dir):
    return T.ticket_detail(_tickets(spark, sf_dir), AS_OF_DESK, URL)


@register("next_ticket_card_per_user", with_views(["tickets"], f"""
, w AS (SELECT *, {weight_expr()} AS weight FROM tickets WHERE {EXCLUDE_QUEUES} AND assignedResourceID IS NOT NULL)
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assignedResourceID ORDER BY weight DESC, id) AS rn FROM w)
           WHERE rn = 1)
, s AS ({_sla_unnest_sql().replace("FROM tickets", "FROM best")})
, l AS (SELECT id, string_agg(sla_name || ': ' || {_STATUS_TEXT} || ' | ' || due_date || ' | ' || met_date || ' | ' || {_TIME_STATUS}, '; ' ORDER BY pos) AS timeline
        FROM s GROUP BY id)
SELECT b.assignedResourceID, b.id, b.title,
       CASE WHEN length(coalesce(description, '')) > 200 THEN substring(description, 1, 200) || '...' ELSE coalesce(description, '') END AS description,
       {_PRIO_LABEL} AS priority_text, {_PRIO_COLOR} AS priority_color, {_STATUS_LABEL} AS status_text,
       l.timeline, {_url_sql('b.id')} AS url, CAST(b.weight AS BIGINT) AS points,
       '{{"tickets":[{{"ticket_id":' || CAST(b.id AS VARCHAR) || ',"title":"' || b.title || '","points":' || CAST(b.weight AS VARCHAR) || '}}]}}' AS result_data
FROM best b JOIN l ON l.id = b.id
"""))
def next_ticket_card_per_user(spark, sf_dir):
    """The next-ticket command for every user in one job: T10 -> T6 -> T7 per user -> T13 card data
    (+ T14 digest for the command log)."""
    t = T.exclude_queues(_tickets(spark, sf_dir)).filter(F.col("assignedResourceID").isNotNull())
    best = T.next_ticket(T.ticket_weight(t, AS_OF_DESK), per=["assignedResourceID"], n=1)
    return T.ticket_detail(best, AS_OF_DESK, URL, keep=[
        "assignedResourceID", F.col("weight").alias("points"), T.ticket_digest(best).alias("result_data")])
