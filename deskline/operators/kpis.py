"""KPI operators.

Team KPIs are global aggregates; several of them over one table come from a single scan as
conditional aggregates. The long KPI table is a ``unionByName`` of one-row aggregates, so
scalars from different tables are combined without joins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.constants import (
    AGING_DAYS, AGING_EXCLUDED_STATUS, KPI_DEFINITIONS, KPI_QUEUES, REACTIVE_TICKET_CATEGORY, ROLLING_DAYS, SUPPORT_CALL_CATEGORY,
    SUPPORT_CALL_DIRECTION, UTILIZATION_BASE_HOURS,
)
from deskline.functions import day_diff, minute_diff, week_end, week_start

KPI_COLS = ["kpi_name", "category", "kpi_type", "value"]


def _ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def _kpi_row(df: DataFrame, name: str, category: str, value: Column, kpi_type: str = "Team") -> DataFrame:
    return df.agg(value.cast("double").alias("value")).select(
        F.lit(name).alias("kpi_name"), F.lit(category).alias("category"), F.lit(kpi_type).alias("kpi_type"), "value")


def _aging_cond(as_of, days: int, excluded: Sequence[int]) -> Column:
    # NOT IN drops a null status here (unlike the queue filter T10).
    return (day_diff("createDate", _ts(as_of)) > days) & ~F.col("status").isin(list(excluded))


def desk_ticket_kpis(tickets: DataFrame, as_of, queues: Sequence[int] = KPI_QUEUES, aging_days: int = AGING_DAYS,
                     aging_excluded: Sequence[int] = AGING_EXCLUDED_STATUS) -> DataFrame:
    """K1-K4 in one scan: totals, SLA met, aging > 5 days, average response / resolution minutes.

    Averages use T-SQL minute boundaries (B9), are truncated toward zero, and are 0 when empty.
    """
    in_q = F.col("queueID").isin(list(queues))
    resp = F.when(in_q & F.col("firstResponseDateTime").isNotNull(), minute_diff("createDate", "firstResponseDateTime"))
    reso = F.when(in_q & F.col("resolvedDateTime").isNotNull(), minute_diff("createDate", "resolvedDateTime"))
    return tickets.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_tickets"),
        F.coalesce(F.sum(F.when(F.col("serviceLevelAgreementHasBeenMet"), 1).otherwise(0)), F.lit(0))
         .cast("bigint").alias("sla_met"),
        F.count_if(_aging_cond(as_of, aging_days, aging_excluded)).cast("bigint").alias("aging_over_5"),
        F.coalesce(F.avg(resp).cast("bigint"), F.lit(0).cast("bigint")).alias("avg_response_minutes"),
        F.coalesce(F.avg(reso).cast("bigint"), F.lit(0).cast("bigint")).alias("avg_resolution_minutes"),
    )


def aging_tickets(tickets: DataFrame, as_of, days: int = AGING_DAYS,
                  excluded: Sequence[int] = AGING_EXCLUDED_STATUS) -> DataFrame:
    """K2 as a result table: the open tickets older than ``days`` (their count is the KPI)."""
    return (tickets.filter(_aging_cond(as_of, days, excluded))
            .select("id", "companyID", "status", day_diff("createDate", _ts(as_of)).cast("int").alias("age_days")))


def kpi_sources(tickets: DataFrame, calls: DataFrame, csat: DataFrame, endpoints: DataFrame, uptime: DataFrame,
                desk_as_of, events_as_of, queues: Sequence[int] = KPI_QUEUES) -> dict[str, Callable[[], DataFrame]]:
    """The team KPIs by source, each as a builder of long rows (kpi_name, category, kpi_type, value), so
    that one source's fault cannot touch another's KPIs. Every source is scanned once."""
    since = _ts(events_as_of) - F.expr(f"INTERVAL {ROLLING_DAYS} DAYS")

    def desk() -> DataFrame:  # K1-K4
        named = [("SLA Met", "sla_met"), ("Aging Tickets", "aging_over_5"), ("Avg Response Time", "avg_response_minutes"),
                 ("Avg Resolution Time", "avg_resolution_minutes")]
        return desk_ticket_kpis(tickets, desk_as_of, queues).select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("kpi_name"), F.col(c).cast("double").alias("value")) for n, c in named])).alias("k")).select(
            "k.kpi_name", F.lit("Service Desk").alias("category"), F.lit("Team").alias("kpi_type"), "k.value")

    def reactive() -> DataFrame:
        # Tickets in the reactive category / endpoints (null when there are none), one aggregate
        # over the union of both inputs instead of a join of two scalars.
        both = (tickets.select((F.col("category") == REACTIVE_TICKET_CATEGORY).cast("int").alias("a"), F.lit(0).alias("b"))
                .unionByName(endpoints.select(F.lit(0).alias("a"), F.lit(1).alias("b"))))
        return _kpi_row(both, "Reactive Ticket per Endpoint", "Field Team",
                        F.sum("a").cast("double") / F.nullif(F.sum("b"), F.lit(0)))

    return {
        "service_desk": desk,
        "calls": lambda: _kpi_row(calls, "# of Support Calls", "Service Desk", F.count_if(
            (F.col("direction") == SUPPORT_CALL_DIRECTION) & (F.col("category") == SUPPORT_CALL_CATEGORY))),
        "csat": lambda: _kpi_row(csat, "CSAT Rolling 30", "Service Desk",
                                 F.avg(F.when(F.col("response_date") >= since, F.col("score")))),
        "endpoints": lambda: _kpi_row(endpoints, "Endpoints Patched", "Field Team",
                                      F.count_if(F.col("patches_missing") == 0)),
        "uptime": lambda: _kpi_row(uptime, "Uptime Rolling 30 Days", "Field Team",
                                   F.avg(F.when(F.col("recorded_date") >= since, F.col("uptime_percentage")))),
        "reactive": reactive,
    }


def team_kpis(tickets: DataFrame, calls: DataFrame, csat: DataFrame, endpoints: DataFrame, uptime: DataFrame,
              desk_as_of, events_as_of, queues: Sequence[int] = KPI_QUEUES) -> DataFrame:
    """K1-K4, K7-K11 as long rows (kpi_name, category, kpi_type, value)."""
    parts = [build() for build in kpi_sources(tickets, calls, csat, endpoints, uptime, desk_as_of, events_as_of,
                                              queues).values()]
    return reduce(DataFrame.unionByName, parts)


def weekly_response_resolution(tickets: DataFrame, resources: DataFrame, as_of) -> DataFrame:
    """K5: per resource for the week of ``as_of`` (Sunday..Saturday, D8).

    ``createDate BETWEEN start AND end`` with date bounds excludes Saturday after midnight (D9).
    Sums of minute differences (B9, null -> 0), ticket count, averages over *all* tickets.
    """
    start, end = week_start(_ts(as_of)), week_end(_ts(as_of))
    t = tickets.filter(F.col("createDate").between(start.cast("timestamp_ntz"), end.cast("timestamp_ntz")))
    r = resources.select(F.col("id").alias("_rid"), F.col("email"))
    j = t.join(r, t["assignedResourceID"] == r["_rid"], "left")
    g = j.groupBy("email", "assignedResourceID").agg(
        F.coalesce(F.sum(minute_diff("createDate", "firstResponseDateTime")), F.lit(0)).cast("bigint")
         .alias("total_response_time"),
        F.coalesce(F.sum(minute_diff("createDate", "resolvedDateTime")), F.lit(0)).cast("bigint")
         .alias("total_resolution_time"),
        F.count("id").cast("bigint").alias("ticket_count"))
    return g.select(
        F.coalesce(F.col("email"), F.lit("")).alias("emailAddress"),
        F.coalesce(F.col("assignedResourceID"), F.lit(0).cast("bigint")).alias("user_id"),
        "total_response_time", "total_resolution_time", "ticket_count",
        F.when(F.col("ticket_count") > 0, F.col("total_response_time") / F.col("ticket_count")).otherwise(F.lit(0.0))
         .alias("avg_response_time"),
        F.when(F.col("ticket_count") > 0, F.col("total_resolution_time") / F.col("ticket_count")).otherwise(F.lit(0.0))
         .alias("avg_resolution_time"),
        start.alias("weekStartDate"), end.alias("weekEndDate"))


def week_filter(col: str, as_of) -> Column:
    """``col BETWEEN week start AND week end`` with date bounds."""
    start, end = week_start(_ts(as_of)), week_end(_ts(as_of))
    return F.col(col).between(start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))


def weekly_utilization(entries: DataFrame, resources: DataFrame, as_of,
                       base_hours: float = UTILIZATION_BASE_HOURS) -> DataFrame:
    """K6: hours worked per creator for the week of ``as_of``; percentage of ``base_hours``.

    Grouped by (email, creatorUserID) -- the creator, not the resource, is the id.
    """
    start, end = week_start(_ts(as_of)), week_end(_ts(as_of))
    t = entries.filter(week_filter("dateWorked", as_of))
    r = resources.select(F.col("id").alias("_rid"), F.col("email"))
    j = t.join(r, t["creatorUserID"] == r["_rid"], "left")
    g = j.groupBy("email", "creatorUserID").agg(
        F.coalesce(F.sum("hoursWorked"), F.lit(0.0)).alias("total_hours"))
    return g.select(
        F.coalesce(F.col("email"), F.lit("")).alias("emailAddress"),
        F.col("creatorUserID").alias("user_id"),
        "total_hours",
        (F.col("total_hours") / F.lit(base_hours) * 100).alias("utilization_percentage"),
        start.alias("weekStartDate"), end.alias("weekEndDate"))


def utilization_rows(weekly: DataFrame) -> DataFrame:
    """ResourceUtilization columns from K6 output."""
    return weekly.select(F.col("user_id").alias("resourceID"), "emailAddress", "weekStartDate", "weekEndDate",
                         F.col("total_hours").alias("totalHoursWorked"),
                         F.col("utilization_percentage").alias("utilizationPercentage"))


def upsert_utilization(target: DataFrame, weekly: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ResourceUtilization on (resourceID, weekStartDate); weekEndDate only on insert."""
    from deskline.operators.upsert import upsert
    return upsert(target, utilization_rows(weekly), ["resourceID", "weekStartDate"], ["totalHoursWorked"],
                  update_cols=["totalHoursWorked", "utilizationPercentage", "emailAddress"])


def kpi_register(existing: DataFrame, definitions: Sequence[tuple[str, str, str]] = KPI_DEFINITIONS) -> DataFrame:
    """Registry (id, name, description, category, type); definitions not yet present get new ids
    ``max(id) + number`` in (category, name, type) order, description ''. No KPI is computed for it, and
    the definitions are literals, so nothing but the stored registry is read."""
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(t).alias("type"))
                       for n, c, t in sorted(set(definitions), key=lambda d: (d[1], d[0], d[2]))])
    held = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"),
                        F.collect_set(F.concat_ws("\n", "name", "category", "type")).alias("known"))
    missing = F.filter(wanted, lambda d: ~F.array_contains("known", F.concat_ws("\n", d["name"], d["category"], d["type"])))
    added = held.select("base", F.posexplode(missing).alias("i", "d")).select(
        (F.col("base") + F.col("i") + 1).cast("bigint").alias("id"), "d.name", F.lit("").alias("description"),
        "d.category", "d.type")
    return existing.select("id", "name", "description", "category", "type").unionByName(added)


def kpi_values(registry: DataFrame, kpi_rows: DataFrame, as_of) -> DataFrame:
    """Values to append, keyed by KPI id and the run date (replays of a run are idempotent)."""
    r = registry.select(F.col("id").alias("kpi_id"), F.col("name").alias("kpi_name"), "category",
                        F.col("type").alias("kpi_type"))
    cols = ["kpi_id", "kpi_name", "resource_id", "value", "date_recorded"]
    rows = kpi_rows if "resource_id" in kpi_rows.columns else kpi_rows.withColumn(
        "resource_id", F.lit(None).cast("bigint"))
    return (rows.join(r, ["kpi_name", "category", "kpi_type"])
            .withColumn("date_recorded", _ts(as_of).cast("date")).select(*cols))


def utilization_kpis(util: DataFrame) -> DataFrame:
    """K15 rows of K6: utilisation % per resource."""
    return util.select(F.lit("Utilization").alias("kpi_name"), F.lit("Resource").alias("category"),
                       F.lit("Individual").alias("kpi_type"), F.col("user_id").cast("bigint").alias("resource_id"),
                       F.col("utilization_percentage").alias("value"))


def response_kpis(resp: DataFrame) -> DataFrame:
    """K15 rows of K5: average response and resolution per resource."""
    named = F.array(F.struct(F.lit("Avg Response Time").alias("n"), F.col("avg_response_time").alias("v")),
                    F.struct(F.lit("Avg Resolution Time").alias("n"), F.col("avg_resolution_time").alias("v")))
    return resp.select(F.explode(named).alias("k"), F.col("user_id").cast("bigint").alias("resource_id")).select(
        F.col("k.n").alias("kpi_name"), F.lit("Resource").alias("category"), F.lit("Individual").alias("kpi_type"),
        "resource_id", F.col("k.v").alias("value"))


def individual_kpis(util: DataFrame, resp: DataFrame) -> DataFrame:
    """K15 individual rows: weekly utilisation % (K6) and average response / resolution (K5)."""
    return utilization_kpis(util).unionByName(response_kpis(resp))
