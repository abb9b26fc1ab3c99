"""Registered contract, revenue and upsert queries (R1-R9, U2-U5, I4, I5) and their oracle SQL.

Feeds are split at ``FEED_CUTOFF``: rows that started before it are already in the table (first
run), the rest arrive in the second run -- so every upsert sees matched and new keys. Within one
id the arrival order starts with the same stamp, so earlier runs always hold earlier arrivals.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from deskline.operators import contracts as R
from deskline.operators import ingest as I
from deskline.operators.ranking import stored
from deskline.operators.upsert import empty_like, latest_rows
from deskline.plans.registry import register
from deskline.plans.sqlbits import DESK
from deskline.session import drop_finished_shuffles, ensure_session, scratch_dir
from deskline.sources.fixtures import ARRIVAL_COLS, AS_OF_DESK, views, with_views
from deskline.sources.schemas import CONTRACT_UNIT_COLS, TIME_ENTRY_COLS

FEED_CUTOFF = AS_OF_DESK

# ---------------------------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------------------------


def _v(spark, sf_dir, *names):
    ensure_session(spark)
    return views(spark, sf_dir, *names)


def unit_runs(spark, sf_dir):
    """ContractUnits after the first run (old half of the feed) and after the second (all)."""
    rows = I.normalize_units(_v(spark, sf_dir, "contract_unit_rows")["contract_unit_rows"])
    table = empty_like(rows.select(*CONTRACT_UNIT_COLS))
    old = rows.filter(F.col("startDate") < F.lit(FEED_CUTOFF).cast("timestamp_ntz"))
    new = rows.filter(~(F.col("startDate") < F.lit(FEED_CUTOFF).cast("timestamp_ntz")))
    run1, _ = I.upsert_units(table, old, ARRIVAL_COLS, target_empty=True)
    run2, _ = I.upsert_units(run1, new, ARRIVAL_COLS)
    return run1, run2


def units_current(spark, sf_dir):
    """ContractUnits holding the whole feed (same rows as both runs, one dedupe)."""
    rows = I.normalize_units(_v(spark, sf_dir, "contract_unit_rows")["contract_unit_rows"])
    return I.upsert_units(empty_like(rows.select(*CONTRACT_UNIT_COLS)), rows, ARRIVAL_COLS, target_empty=True)[0]


def time_entries_table(spark, sf_dir, as_of=AS_OF_DESK):
    """TimeEntries after both runs of the time-entry feed."""
    rows = I.normalize_time_entries(_v(spark, sf_dir, "time_entry_rows")["time_entry_rows"], as_of)
    table = empty_like(rows.select(*TIME_ENTRY_COLS))
    old = rows.filter(F.col("dateWorked") < F.lit(FEED_CUTOFF).cast("timestamp_ntz"))
    new = rows.filter(~(F.col("dateWorked") < F.lit(FEED_CUTOFF).cast("timestamp_ntz")))
    run1, _ = I.upsert_time_entries(table, old, ARRIVAL_COLS, target_empty=True)
    run2, _ = I.upsert_time_entries(run1, new, ARRIVAL_COLS)
    return run2


def time_entries_current(spark, sf_dir, as_of=AS_OF_DESK, columns=TIME_ENTRY_COLS, where=None):
    """TimeEntries holding the whole feed (same rows as both runs), narrowed to ``columns`` and
    the rows matching ``where`` (see ``latest_rows``)."""
    rows = I.normalize_time_entries(_v(spark, sf_dir, "time_entry_rows")["time_entry_rows"], as_of)
    return latest_rows(rows, ["id"], ARRIVAL_COLS, columns, where)


def summary_source(spark, sf_dir, units):
    v = _v(spark, sf_dir, "contracts", "clients", "contract_services")
    return R.contract_summary(v["contracts"], v["clients"], v["contract_services"], units)


def summary_table(spark, sf_dir):
    """ContractSummary after one U4 run over the full ContractUnits table."""
    src = summary_source(spark, sf_dir, units_current(spark, sf_dir))
    snap, _ = R.upsert_contract_summary(R.summary_table_schema(src), src, AS_OF_DESK, target_empty=True)
    return snap


def revenue_rows(spark, sf_dir):
    """R2 -> R4 -> R3 -> R6 -> R7, the summary stored, as R3 and R4 both read it."""
    summ = stored(summary_table(spark, sf_dir), "contract_summary")
    tickets = _v(spark, sf_dir, "tickets")["tickets"]
    return R.revenue_rows(summ, R.tickets_per_contract_month(tickets, summ), AS_OF_DESK)


# ---------------------------------------------------------------------------------------------
# Oracle SQL pieces
# ---------------------------------------------------------------------------------------------
_ARR_DESC = ", ".join(f"{c} DESC" for c in ARRIVAL_COLS)

_CU = f"""
, cu AS (SELECT id, contractID, serviceID, startDate, endDate, CAST(NULL AS TIMESTAMP) AS approveAndPostDate,
                coalesce(unitCost, 0.0) AS unitCost, coalesce(unitPrice, 0.0) AS unitPrice,
                coalesce(internalCurrencyPrice, 0.0) AS internalCurrencyPrice,
                CAST(NULL AS BIGINT) AS organizationalLevelAssociationID,
                coalesce(invoiceDescription, '') AS invoiceDescription, coalesce(units, 0.0) AS units
         FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_ARR_DESC}) AS rn FROM contract_unit_rows) WHERE rn = 1)
"""

_CU_OLD = f"""
, cu_old AS (SELECT id, serviceID FROM contract_unit_rows WHERE startDate < TIMESTAMP '{FEED_CUTOFF}' GROUP BY id, serviceID)
"""


def _src(units: str, name: str) -> str:
    """R1 over the units relation ``units`` (a CTE name or a parenthesised subquery): each described
    service of a known client's contract, once for every unit row of the service."""
    return f"""
, {name}_owned AS (SELECT contracts.id AS ContractID, contractName AS ContractName, companyID AS CompanyID, billingPreference AS BillingPreference,
                   companyName AS CompanyName FROM clients, contracts WHERE clients.id = companyID)
, {name}_priced AS (SELECT serviceID AS ServiceID, startDate AS StartDate, endDate AS EndDate, id AS UnitID, coalesce(units, 0) AS Units,
                    coalesce(internalCurrencyPrice, 0) AS price FROM {units})
, {name} AS (SELECT ContractID, ContractName, CompanyID, CompanyName, ServiceID, svc.internalDescription AS ServiceName, StartDate, EndDate,
                Units, price AS UnitPrice, price AS Cost, BillingPreference, Units * price AS TotalRevenue, Units * price AS TotalCost, UnitID
         FROM {name}_priced JOIN (SELECT id AS ServiceID, contractID AS ContractID, internalDescription FROM contract_services
                                  WHERE internalDescription IS NOT NULL) svc USING (ServiceID) JOIN {name}_owned USING (ContractID))
"""


_SUMM = """
, summ AS (SELECT * EXCLUDE (rn, UnitID) FROM (SELECT *, row_number() OVER (PARTITION BY ContractID, ServiceID ORDER BY StartDate DESC, UnitID DESC) AS rn FROM src) WHERE rn = 1)
"""
_CONTRACT_VIEWS = ["contract_unit_rows", "contracts", "clients", "contract_services"]

_SUMMARY_SELECT = ("ContractID, ContractName, CompanyID, CompanyName, ServiceID, ServiceName, StartDate, EndDate, Units, "
                   "UnitPrice, Cost, BillingPreference, TotalRevenue, TotalCost")

_TICKET_COUNTS = """
, covered AS (SELECT CompanyID AS ClientID, ContractID, date_trunc('month', createDate) AS month, tickets.id AS ticket
              FROM summ JOIN tickets USING (companyID) WHERE createDate >= StartDate AND createDate <= EndDate)
, tcount AS (SELECT ClientID, ContractID, CAST(date_part('year', month) AS INT) AS TicketYear, CAST(date_part('month', month) AS INT) AS TicketMonth,
                    CAST(count(ticket) AS BIGINT) AS TicketCount FROM covered GROUP BY ClientID, ContractID, month)
"""

_SPINE = f"""
, spine AS (SELECT CAST(CompanyID AS VARCHAR) AS ClientID, CompanyName AS ClientName, CAST(ContractID AS VARCHAR) AS ContractID,
                   ContractName, ServiceID, ServiceName, TotalRevenue, TotalCost, StartDate AS cur, coalesce(EndDate, {DESK}) AS stop
            FROM summ WHERE StartDate IS NOT NULL AND StartDate <= coalesce(EndDate, {DESK})
            UNION ALL
            SELECT ClientID, ClientName, ContractID, ContractName, ServiceID, ServiceName, TotalRevenue, TotalCost,
                   cur + INTERVAL 1 MONTH, stop FROM spine WHERE cur + INTERVAL 1 MONTH <= stop)
, rev AS (SELECT ClientID, ClientName, ContractID, ContractName, ServiceID, ServiceName, strftime(cur, '%Y-%m-01') AS RevenueMonth,
                 coalesce(TotalRevenue, 0.0) AS MonthlyRevenue, coalesce(TotalCost, 0.0) AS MonthlyCost FROM spine)
"""

_RWT = """
, tk AS (SELECT CAST(ClientID AS VARCHAR) AS ClientID, CAST(ContractID AS VARCHAR) AS ContractID,
                CAST(TicketYear AS VARCHAR) || '-' || lpad(CAST(TicketMonth AS VARCHAR), 2, '0') || '-01' AS RevenueMonth, TicketCount
         FROM tcount)
, rwt AS (SELECT r.ClientID, coalesce(r.ClientName, 'Unknown Client') AS ClientName, r.ContractID,
                 coalesce(r.ContractName, 'Unknown Contract') AS ContractName, coalesce(r.ServiceID, 0) AS ServiceID,
                 coalesce(r.ServiceName, 'Unknown Service') AS ServiceName, r.RevenueMonth,
                 coalesce(r.MonthlyRevenue, 0.0) AS MonthlyRevenue, coalesce(r.MonthlyCost, 0.0) AS MonthlyCost,
                 CAST(coalesce(tk.TicketCount, 0) AS BIGINT) AS TicketsCreated
          FROM rev r LEFT JOIN tk ON r.ClientID = tk.ClientID AND r.ContractID = tk.ContractID AND r.RevenueMonth = tk.RevenueMonth)
"""

# ---------------------------------------------------------------------------------------------
# Registered queries
# ---------------------------------------------------------------------------------------------


@register("upsert_contract_units", with_views(["contract_unit_rows"], _CU + "SELECT * FROM cu"))
def upsert_contract_units(spark, sf_dir):
    """I4 + U2: two runs of the unit feed into ContractUnits."""
    return unit_runs(spark, sf_dir)[1]


@register("upsert_time_entries", with_views(["time_entry_rows"], f"""
SELECT id, coalesce(contractID, 0) AS contractID, CAST(NULL AS BIGINT) AS contractServiceBundleID,
       CAST(NULL AS BIGINT) AS contractServiceID, CAST(NULL AS TIMESTAMP) AS createDateTime, creatorUserID, dateWorked,
       CAST(NULL AS TIMESTAMP) AS endDateTime, hoursToBill, hoursWorked, CAST(NULL AS VARCHAR) AS internalNotes,
       isNonBillable, coalesce(lastModifiedDateTime, {DESK}) AS lastModifiedDateTime, resourceID,
       CAST(NULL AS BIGINT) AS roleID, CAST(NULL AS TIMESTAMP) AS startDateTime, CAST(NULL AS VARCHAR) AS summaryNotes,
       CAST(NULL AS BIGINT) AS taskID, ticketID, timeEntryType
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_ARR_DESC}) AS rn FROM time_entry_rows) WHERE rn = 1
"""))
def upsert_time_entries(spark, sf_dir):
    """I5 + U3: two runs of the time-entry feed into TimeEntries."""
    return time_entries_table(spark, sf_dir)


@register("contract_summary", with_views(_CONTRACT_VIEWS, _CU + _src("cu", "src") + "SELECT * FROM src"))
def contract_summary(spark, sf_dir):
    """R1 over the full ContractUnits table (every covering unit row, before the U4 dedupe)."""
    return summary_source(spark, sf_dir, units_current(spark, sf_dir))


@register("upsert_contract_summary", with_views(_CONTRACT_VIEWS, _CU + _CU_OLD + _src("cu", "src")
                                                + _src("(SELECT cu.* FROM cu JOIN cu_old USING (id))", "src_old")
                                                + _SUMM + f"""
, old_keys AS (SELECT DISTINCT ContractID, ServiceID FROM src_old)
SELECT {_SUMMARY_SELECT}, CASE WHEN k.ContractID IS NOT NULL THEN {DESK} END AS LastUpdated
FROM summ s LEFT JOIN old_keys k USING (ContractID, ServiceID)
"""))
def upsert_contract_summary(spark, sf_dir):
    """U4 run twice: after the first unit run, then after the second; matched keys get LastUpdated."""
    units1, units2 = unit_runs(spark, sf_dir)
    src1 = summary_source(spark, sf_dir, units1)
    src2 = summary_source(spark, sf_dir, units2)
    snap1, _ = R.upsert_contract_summary(R.summary_table_schema(src1), src1, AS_OF_DESK, target_empty=True)
    snap2, _ = R.upsert_contract_summary(snap1, src2, AS_OF_DESK)
    return snap2


@register("tickets_per_contract_month", with_views(_CONTRACT_VIEWS + ["tickets"], _CU + _src("cu", "src") + _SUMM
                                                   + _TICKET_COUNTS + "SELECT * FROM tcount"))
def tickets_per_contract_month(spark, sf_dir):
    """Equi + range join of tickets with ContractSummary, counted per month."""
    summ = summary_table(spark, sf_dir)
    return R.tickets_per_contract_month(_v(spark, sf_dir, "tickets")["tickets"], summ)


@register("monthly_revenue", with_views(_CONTRACT_VIEWS, _CU + _src("cu", "src") + _SUMM + _SPINE + "SELECT * FROM rev",
                                        recursive=True))
def monthly_revenue(spark, sf_dir):
    """R2 + R4 + R5: revenue rows per month with the drifting month walk."""
    return R.monthly_revenue(R.contracts_frame(summary_table(spark, sf_dir)), AS_OF_DESK).select(*R.REVENUE_COLS)


@register("revenue_with_tickets", with_views(_CONTRACT_VIEWS + ["tickets"], _CU + _src("cu", "src") + _SUMM + _SPINE
                                             + _TICKET_COUNTS + _RWT + "SELECT * FROM rwt", recursive=True))
def revenue_with_tickets(spark, sf_dir):
    """R6 + R7: revenue rows joined with ticket counts, defaults filled."""
    return revenue_rows(spark, sf_dir)


@register("upsert_client_month", with_views(_CONTRACT_VIEWS + ["tickets"], _CU + _src("cu", "src") + _SUMM + _SPINE
                                            + _TICKET_COUNTS + _RWT + f"""
SELECT ClientID, arg_min(ClientName, ServiceID) AS ClientName, ContractID, arg_min(ContractName, ServiceID) AS ContractName,
       min(ServiceID) AS ServiceID, arg_min(ServiceName, ServiceID) AS ServiceName, RevenueMonth,
       arg_max(MonthlyRevenue, ServiceID) AS MonthlyRevenue, arg_max(TicketsCreated, ServiceID) AS TicketsCreated,
       CASE WHEN count(*) > 1 THEN {DESK} END AS LastUpdated
FROM rwt GROUP BY ClientID, ContractID, RevenueMonth
""", recursive=True))
def upsert_client_month(spark, sf_dir):
    """U5 into an empty ClientMonthlySummary (R9's store step)."""
    rows = revenue_rows(spark, sf_dir)
    snap, _ = R.upsert_client_month(R.client_month_table(rows), rows, AS_OF_DESK, target_empty=True)
    return snap


@register("revenue_run", with_views(_CONTRACT_VIEWS + ["tickets"], _CU + _src("cu", "src") + _SUMM + _SPINE
                                    + _TICKET_COUNTS + _RWT + f"""
SELECT ClientID, arg_min(ClientName, ServiceID) AS ClientName, ContractID, arg_min(ContractName, ServiceID) AS ContractName,
       min(ServiceID) AS ServiceID, arg_min(ServiceName, ServiceID) AS ServiceName, RevenueMonth,
       arg_max(MonthlyRevenue, ServiceID) AS MonthlyRevenue, arg_max(TicketsCreated, ServiceID) AS TicketsCreated,
       {DESK} AS LastUpdated
FROM rwt GROUP BY ClientID, ContractID, RevenueMonth
""", recursive=True))
def revenue_run(spark, sf_dir):
    """R8 + R9 + U5 on existing rows: the whole refresh job, run twice; the second run finds every key."""
    from deskline.plans.jobs import MONTHLY_SCHEMA, run_revenue
    from deskline.sources import sinks
    v = _v(spark, sf_dir, "contracts", "clients", "contract_services", "tickets")
    root = scratch_dir(spark, "revenue-run")
    units = stored(units_current(spark, sf_dir), "contract_units")
    for _ in range(2):
        drop_finished_shuffles(spark)
        run_revenue(spark, root, v["contracts"], v["clients"], v["contract_services"], units, v["tickets"], AS_OF_DESK)
    like = spark.createDataFrame([], f"{MONTHLY_SCHEMA}, LastUpdated timestamp_ntz")
    return sinks.read_snapshot(spark, f"{root}/ClientMonthlySummary", schema=like.schema)


def _earlier(sql: str) -> str:
    """CTEs of the first run: the same rules over its own units."""
    return re.sub(r"\b(src|summ|covered|tcount|spine|rev|tk|rwt)\b", r"\1_old", sql)


#: ContractUnits after the first run: of each id the last of the rows that had arrived by then.
_CU_FIRST = _CU.replace(", cu AS", ", cu_first AS").replace(
    "FROM contract_unit_rows)", f"FROM contract_unit_rows WHERE startDate < TIMESTAMP '{FEED_CUTOFF}')")


def _months(rows: str) -> str:
    return f"""SELECT ClientID, ContractID, RevenueMonth, arg_min(ClientName, ServiceID) AS ClientName, arg_min(ContractName, ServiceID) AS ContractName,
       min(ServiceID) AS ServiceID, arg_min(ServiceName, ServiceID) AS ServiceName, arg_max(MonthlyRevenue, ServiceID) AS MonthlyRevenue,
       arg_max(TicketsCreated, ServiceID) AS TicketsCreated, count(*) AS n FROM {rows} GROUP BY ClientID, ContractID, RevenueMonth"""


@register("revenue_refresh", with_views(
    _CONTRACT_VIEWS + ["tickets"],
    _CU + _CU_FIRST + _src("cu", "src") + _src("cu_first", "src_old") + _SUMM + _earlier(_SUMM)
    + _SPINE + _earlier(_SPINE) + _TICKET_COUNTS + _earlier(_TICKET_COUNTS) + _RWT + _earlier(_RWT) + f"""
, m_old AS ({_months('rwt_old')})
, m_new AS ({_months('rwt')})
SELECT coalesce(o.ClientID, w.ClientID) AS ClientID, coalesce(o.ContractID, w.ContractID) AS ContractID,
       coalesce(o.RevenueMonth, w.RevenueMonth) AS RevenueMonth,
       CASE WHEN o.n IS NULL THEN w.ClientName ELSE o.ClientName END AS ClientName,
       CASE WHEN o.n IS NULL THEN w.ContractName ELSE o.ContractName END AS ContractName,
       CASE WHEN o.n IS NULL THEN w.ServiceID ELSE o.ServiceID END AS ServiceID,
       CASE WHEN o.n IS NULL THEN w.ServiceName ELSE o.ServiceName END AS ServiceName,
       CASE WHEN w.n IS NULL THEN o.MonthlyRevenue ELSE w.MonthlyRevenue END AS MonthlyRevenue,
       CASE WHEN w.n IS NULL THEN o.TicketsCreated ELSE w.TicketsCreated END AS TicketsCreated,
       CASE WHEN (o.n IS NOT NULL AND w.n IS NOT NULL) OR coalesce(w.n, o.n) > 1 THEN {DESK} END AS LastUpdated
FROM m_old o FULL JOIN m_new w ON o.ClientID = w.ClientID AND o.ContractID = w.ContractID AND o.RevenueMonth = w.RevenueMonth
""", recursive=True))
def revenue_refresh(spark, sf_dir):
    """U4 + U5 by change sets: a refresh after the first unit run and one after the second; unchanged months are
    neither read nor written, and the result is that of two full runs."""
    from deskline.plans.jobs import client_months, refresh_revenue
    v = _v(spark, sf_dir, "contracts", "clients", "contract_services", "tickets")
    root = scratch_dir(spark, "revenue-refresh")
    for run in unit_runs(spark, sf_dir):
        units = stored(run, "contract_units")
        drop_finished_shuffles(spark)
        refresh_revenue(spark, root, v["contracts"], v["clients"], v["contract_services"], units, v["tickets"], AS_OF_DESK)
    return client_months(spark, root)
