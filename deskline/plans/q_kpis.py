"""Registered KPI queries (K1-K15, U6) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deskline import constants as K
from deskline.operators import kpis as KP
from deskline.plans import jobs
from deskline.plans.q_contracts import _ARR_DESC, time_entries_current
from deskline.plans.registry import register
from deskline.plans.sqlbits import DESK, EVENTS, in_list
from deskline.session import ensure_session, scratch_dir
from deskline.sources.fixtures import AS_OF_DESK, AS_OF_EVENTS, AS_OF_SUNDAY, views, with_views


def _week_entries(spark, sf_dir, as_of=AS_OF_DESK):
    """The TimeEntries rows K6 reads: the week's rows of the current table, three columns."""
    return time_entries_current(spark, sf_dir, columns=["creatorUserID", "dateWorked", "hoursWorked"],
                                where=KP.week_filter("dateWorked", as_of))


def _v(spark, sf_dir, *names):
    ensure_session(spark)
    return views(spark, sf_dir, *names)


def r6(df, *cols):
    """Averages and sums of doubles depend on summation order in their last bits; registered
    queries show them rounded to 6 places (the oracle SQL rounds the same way)."""
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _team(spark, sf_dir):
    v = _v(spark, sf_dir, "tickets", "call_logs", "csat_responses", "endpoints", "system_uptime")
    return r6(KP.team_kpis(v["tickets"], v["call_logs"], v["csat_responses"], v["endpoints"], v["system_uptime"],
                           AS_OF_DESK, AS_OF_EVENTS), "value")


_Q = in_list(K.KPI_QUEUES)
_TEAM_SQL = f"""
, d AS (SELECT CAST(coalesce(sum(CASE WHEN serviceLevelAgreementHasBeenMet THEN 1 ELSE 0 END), 0) AS DOUBLE) AS sla,
               CAST(count(*) FILTER (WHERE date_diff('day', createDate, {DESK}) > {K.AGING_DAYS} AND status NOT IN ({in_list(K.AGING_EXCLUDED_STATUS)})) AS DOUBLE) AS aging,
               CAST(coalesce(CAST(trunc(avg(date_diff('minute', createDate, firstResponseDateTime)) FILTER (WHERE firstResponseDateTime IS NOT NULL AND queueID IN ({_Q}))) AS BIGINT), 0) AS DOUBLE) AS resp,
               CAST(coalesce(CAST(trunc(avg(date_diff('minute', createDate, resolvedDateTime)) FILTER (WHERE resolvedDateTime IS NOT NULL AND queueID IN ({_Q}))) AS BIGINT), 0) AS DOUBLE) AS reso
        FROM tickets)
, team AS (
  SELECT 'SLA Met' AS kpi_name, 'Service Desk' AS category, 'Team' AS kpi_type, sla AS value FROM d
  UNION ALL SELECT 'Aging Tickets', 'Service Desk', 'Team', aging FROM d
  UNION ALL SELECT 'Avg Response Time', 'Service Desk', 'Team', resp FROM d
  UNION ALL SELECT 'Avg Resolution Time', 'Service Desk', 'Team', reso FROM d
  UNION ALL SELECT '# of Support Calls', 'Service Desk', 'Team', CAST(count(*) FILTER (WHERE direction = 'Inbound' AND category = 'Support') AS DOUBLE) FROM call_logs
  UNION ALL SELECT 'CSAT Rolling 30', 'Service Desk', 'Team', CAST(avg(score) FILTER (WHERE response_date >= {EVENTS} - INTERVAL 30 DAY) AS DOUBLE) FROM csat_responses
  UNION ALL SELECT 'Endpoints Patched', 'Field Team', 'Team', CAST(count(*) FILTER (WHERE patches_missing = 0) AS DOUBLE) FROM endpoints
  UNION ALL SELECT 'Uptime Rolling 30 Days', 'Field Team', 'Team', CAST(avg(uptime_percentage) FILTER (WHERE recorded_date >= {EVENTS} - INTERVAL 30 DAY) AS DOUBLE) FROM system_uptime
  UNION ALL SELECT 'Reactive Ticket per Endpoint', 'Field Team', 'Team',
        CAST((SELECT count(*) FROM tickets WHERE category = 'Support Desk') AS DOUBLE) / nullif((SELECT count(*) FROM endpoints), 0))
"""
_TEAM_VIEWS = ["tickets", "call_logs", "csat_responses", "endpoints", "system_uptime"]


@register("kpi_service_desk", with_views(_TEAM_VIEWS, _TEAM_SQL + "SELECT kpi_name, category, kpi_type, round(value, 6) AS value FROM team WHERE category = 'Service Desk'"))
def kpi_service_desk(spark, sf_dir):
    """K1, K3, K4, K7, K8 (one scan of tickets for K1-K4)."""
    return _team(spark, sf_dir).filter(F.col("category") == "Service Desk")


@register("kpi_field_team", with_views(_TEAM_VIEWS, _TEAM_SQL + "SELECT kpi_name, category, kpi_type, round(value, 6) AS value FROM team WHERE category = 'Field Team'"))
def kpi_field_team(spark, sf_dir):
    """K9, K10, K11."""
    return _team(spark, sf_dir).filter(F.col("category") == "Field Team")


def _aging_sql(as_of: str) -> str:
    return f"""
SELECT id, companyID, status, CAST(date_diff('day', createDate, TIMESTAMP '{as_of}') AS INT) AS age_days
FROM tickets WHERE date_diff('day', createDate, TIMESTAMP '{as_of}') > {K.AGING_DAYS} AND status NOT IN ({in_list(K.AGING_EXCLUDED_STATUS)})
"""


@register("kpi_aging", with_views(["tickets"], _aging_sql(AS_OF_DESK)))
def kpi_aging(spark, sf_dir):
    """K2: tickets open more than 5 days (null status excluded)."""
    return KP.aging_tickets(_v(spark, sf_dir, "tickets")["tickets"], AS_OF_DESK)


def _week(as_of: str) -> tuple[str, str]:
    d = f"CAST(TIMESTAMP '{as_of}' AS DATE)"
    start = f"({d} - CAST(isodow({d}) AS INTEGER))"
    return start, f"({start} + 6)"


def _weekly_response_sql(as_of: str) -> str:
    s, e = _week(as_of)
    return f"""
SELECT coalesce(any_value(email), '') AS emailAddress, coalesce(rid, 0) AS user_id, CAST(sum(a) AS BIGINT) AS total_response_time,
       CAST(sum(b) AS BIGINT) AS total_resolution_time, CAST(sum(n) AS BIGINT) AS ticket_count,
       CASE WHEN sum(n) = 0 THEN 0 ELSE sum(a) / sum(n) END AS avg_response_time,
       CASE WHEN sum(n) = 0 THEN 0 ELSE sum(b) / sum(n) END AS avg_resolution_time, {s} AS weekStartDate, {e} AS weekEndDate
FROM (SELECT assignedResourceID AS rid, (SELECT any_value(email) FROM resources WHERE resources.id = assignedResourceID) AS email,
             coalesce(date_diff('minute', createDate, firstResponseDateTime), 0) AS a,
             coalesce(date_diff('minute', createDate, resolvedDateTime), 0) AS b, (id IS NOT NULL)::INT AS n
      FROM tickets WHERE createDate >= {s} AND createDate <= {e}) per_ticket
GROUP BY rid
"""


@register("weekly_response", with_views(["tickets", "resources"], _weekly_response_sql(AS_OF_DESK)))
def weekly_response(spark, sf_dir):
    """K5 for the week of a Wednesday."""
    v = _v(spark, sf_dir, "tickets", "resources")
    return KP.weekly_response_resolution(v["tickets"], v["resources"], AS_OF_DESK)


@register("weekly_response_sunday", with_views(["tickets", "resources"], _weekly_response_sql(AS_OF_SUNDAY)))
def weekly_response_sunday(spark, sf_dir):
    """K5 run on a Sunday: the week is the *previous* Sunday..Saturday."""
    v = _v(spark, sf_dir, "tickets", "resources")
    return KP.weekly_response_resolution(v["tickets"], v["resources"], AS_OF_SUNDAY)


_TE = f"""
, te AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_ARR_DESC}) AS rn FROM time_entry_rows) WHERE rn = 1)
"""


def _util_sql(src: str, as_of: str, extra_filter: str = "") -> str:
    s, e = _week(as_of)
    return f"""
SELECT coalesce((SELECT any_value(email) FROM resources WHERE resources.id = worked.creatorUserID), '') AS emailAddress,
       creatorUserID AS user_id, total_hours, total_hours * 100 / 40.0 AS utilization_percentage, {s} AS weekStartDate, {e} AS weekEndDate
FROM (SELECT creatorUserID, coalesce(sum(hoursWorked), 0.0) AS total_hours FROM {src} t
      WHERE t.dateWorked >= {s} AND t.dateWorked <= {e} {extra_filter} GROUP BY creatorUserID) worked
"""


@register("weekly_utilization", with_views(["time_entry_rows", "resources"], _TE + ", u AS (" + _util_sql("te", AS_OF_DESK)
                                           + ") SELECT emailAddress, user_id, round(total_hours, 6) AS total_hours, "
                                             "round(utilization_percentage, 6) AS utilization_percentage, weekStartDate, weekEndDate FROM u"))
def weekly_utilization(spark, sf_dir):
    """K6 over the TimeEntries table (after the feed upserts)."""
    v = _v(spark, sf_dir, "resources")
    return r6(KP.weekly_utilization(_week_entries(spark, sf_dir), v["resources"], AS_OF_DESK),
              "total_hours", "utilization_percentage")


@register("upsert_utilization", with_views(["time_entry_rows", "resources"], _TE
          + ", old AS (" + _util_sql("te", AS_OF_DESK, f"AND t.dateWorked < CAST(TIMESTAMP '{AS_OF_DESK}' AS DATE)") + ")"
          + ", new AS (" + _util_sql("te", AS_OF_DESK) + ")" + """
SELECT coalesce(n.user_id, o.user_id) AS resourceID,
       CASE WHEN n.user_id IS NOT NULL THEN n.emailAddress ELSE o.emailAddress END AS emailAddress,
       coalesce(o.weekStartDate, n.weekStartDate) AS weekStartDate,
       coalesce(o.weekEndDate, n.weekEndDate) AS weekEndDate,
       round(CASE WHEN n.user_id IS NOT NULL THEN n.total_hours ELSE o.total_hours END, 6) AS totalHoursWorked,
       round(CASE WHEN n.user_id IS NOT NULL THEN n.utilization_percentage ELSE o.utilization_percentage END, 6) AS utilizationPercentage
FROM old o FULL OUTER JOIN new n ON o.user_id = n.user_id AND o.weekStartDate = n.weekStartDate
"""))
def upsert_utilization(spark, sf_dir):
    """The week's figures from the days before ``as_of`` are stored, then the full week is upserted."""
    v = _v(spark, sf_dir, "resources")
    entries = _week_entries(spark, sf_dir)
    cut = F.lit(AS_OF_DESK).cast("timestamp_ntz").cast("date").cast("timestamp_ntz")
    old = KP.utilization_rows(KP.weekly_utilization(entries.filter(F.col("dateWorked") < cut), v["resources"], AS_OF_DESK))
    snap, _ = KP.upsert_utilization(old, KP.weekly_utilization(entries, v["resources"], AS_OF_DESK))
    return r6(snap, "totalHoursWorked", "utilizationPercentage")


def _no_registry(spark):
    return spark.createDataFrame([], "id bigint, name string, description string, category string, type string")


def _registry(spark, sf_dir):
    team = _team(spark, sf_dir)
    v = _v(spark, sf_dir, "tickets", "resources")
    indiv = KP.individual_kpis(KP.weekly_utilization(_week_entries(spark, sf_dir), v["resources"], AS_OF_DESK),
                               KP.weekly_response_resolution(v["tickets"], v["resources"], AS_OF_DESK))
    rows = team.withColumn("resource_id", F.lit(None).cast("bigint")).unionByName(indiv)
    return KP.kpi_register(_no_registry(spark)), rows


_REG_SQL = """
, names AS (SELECT DISTINCT kpi_name AS name, category, kpi_type AS type FROM team
            UNION SELECT 'Utilization', 'Resource', 'Individual'
            UNION SELECT 'Avg Response Time', 'Resource', 'Individual'
            UNION SELECT 'Avg Resolution Time', 'Resource', 'Individual')
, reg AS (SELECT CAST(row_number() OVER (ORDER BY category, name, type) AS BIGINT) AS id, name, '' AS description, category, type FROM names)
"""


@register("kpi_register", with_views(_TEAM_VIEWS, _TEAM_SQL + _REG_SQL + "SELECT * FROM reg"))
def kpi_register(spark, sf_dir):
    """KPI registry created from an empty one (ids in name order)."""
    ensure_session(spark)
    return KP.kpi_register(_no_registry(spark))


@register("kpi_values", with_views(_TEAM_VIEWS + ["time_entry_rows", "resources"], _TEAM_SQL + _REG_SQL + _TE
          + ", u AS (" + _util_sql("te", AS_OF_DESK) + ")"
          + ", w AS (" + _weekly_response_sql(AS_OF_DESK) + ")" + f"""
, rows AS (SELECT kpi_name, category, kpi_type, CAST(NULL AS BIGINT) AS resource_id, value FROM team
           UNION ALL SELECT 'Utilization', 'Resource', 'Individual', user_id, utilization_percentage FROM u
           UNION ALL SELECT 'Avg Response Time', 'Resource', 'Individual', user_id, avg_response_time FROM w
           UNION ALL SELECT 'Avg Resolution Time', 'Resource', 'Individual', user_id, avg_resolution_time FROM w)
SELECT reg.id AS kpi_id, rows.kpi_name, rows.resource_id, round(rows.value, 6) AS value, CAST({DESK} AS DATE) AS date_recorded
FROM rows JOIN reg ON reg.name = rows.kpi_name AND reg.category = rows.category AND reg.type = rows.kpi_type
"""))
def kpi_values(spark, sf_dir):
    """K13 + K15: team and individual KPI values with registry ids and the run date."""
    reg, rows = _registry(spark, sf_dir)
    return r6(KP.kpi_values(reg, rows, AS_OF_DESK), "value")


def _kpi_run(spark, sf_dir):
    """K14 with a fault in one source's data: the CSAT scores raise when they are read."""
    v = _v(spark, sf_dir, "tickets", "resources", "call_logs", "csat_responses", "endpoints", "system_uptime")
    bad = v["csat_responses"].withColumn("score", F.expr("if(event_id >= 0, raise_error('score'), score)").cast("int"))
    root = scratch_dir(spark, "kpi-run")
    jobs.run_kpis(spark, root, v["tickets"], v["resources"], _week_entries(spark, sf_dir), v["call_logs"], bad,
                  v["endpoints"], v["system_uptime"], AS_OF_DESK, AS_OF_EVENTS)
    return root


@register("kpi_run", with_views(_TEAM_VIEWS + ["time_entry_rows", "resources"], _TEAM_SQL + _REG_SQL + _TE
          + ", u AS (" + _util_sql("te", AS_OF_DESK) + ")"
          + ", w AS (" + _weekly_response_sql(AS_OF_DESK) + ")" + f"""
, rows AS (SELECT kpi_name, category, kpi_type, CAST(NULL AS BIGINT) AS resource_id, value FROM team WHERE kpi_name <> 'CSAT Rolling 30'
           UNION ALL SELECT 'Utilization', 'Resource', 'Individual', user_id, utilization_percentage FROM u
           UNION ALL SELECT 'Avg Response Time', 'Resource', 'Individual', user_id, avg_response_time FROM w
           UNION ALL SELECT 'Avg Resolution Time', 'Resource', 'Individual', user_id, avg_resolution_time FROM w)
SELECT reg.id AS kpi_id, rows.kpi_name, rows.resource_id, round(rows.value, 6) AS value, CAST({DESK} AS DATE) AS date_recorded
FROM rows JOIN reg ON reg.name = rows.kpi_name AND reg.category = rows.category AND reg.type = rows.kpi_type
"""))
def kpi_run(spark, sf_dir):
    """K14 + S4: the values a run stores when one source is broken: all KPIs of the others."""
    root = _kpi_run(spark, sf_dir)
    return r6(spark.read.parquet(f"{root}/kpi_values").select("kpi_id", "kpi_name", "resource_id", "value", "date_recorded"),
              "value")


@register("kpi_run_status", """
SELECT source, CASE WHEN source = 'csat' THEN 'failed' ELSE 'ok' END AS status, source = 'csat' AS has_error,
       CAST('1998-06-17 15:30:00' AS VARCHAR) AS as_of
FROM (VALUES ('service_desk'), ('calls'), ('csat'), ('endpoints'), ('uptime'), ('reactive'), ('utilization'), ('response')) AS v(source)
WHERE (SELECT count(*) FROM events) > 0
""")
def kpi_run_status(spark, sf_dir):
    """The status rows of the same run."""
    root = _kpi_run(spark, sf_dir)
    return spark.read.parquet(f"{root}/kpi_run_status").select(
        "source", "status", F.col("error").isNotNull().alias("has_error"), "as_of")
