"""Whole jobs that read stored tables and write new snapshots.

A job takes its input DataFrames and ``as_of`` and writes to table folders under a root (the
cluster's shared storage). Stored tables are versioned snapshots (``deskline.sources.sinks``);
append-only tables (KPI values, command log, policies) are appended and partitioned by date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskline.operators import contracts as R
from deskline.operators import documents as D
from deskline.operators import kpis as KP
from deskline.session import drop_finished_shuffles, ensure_checkpoint_dir
from deskline.sources import part_table, sinks
from deskline.streaming.ingest import run_isolated


def _next_version(spark: SparkSession, table: str) -> int:
    v = sinks.latest_version(spark, table)
    return 0 if v is None else v + 1


MONTH_BUCKETS = 16  # hash buckets of contracts in ClientMonthlySummary
PASS_ROWS = 1 << 17  # contract rows whose months are merged in one pass
_BUCKET = "_bucket"


def _bucket_of(contract: str):
    return F.pmod(F.xxhash64(contract), F.lit(MONTH_BUCKETS)).cast("int")


def _month_passes(rows: DataFrame, prev: DataFrame | None, table: DataFrame, n: int, as_of) -> list[DataFrame]:
    """U5 cut by buckets of contracts into as many frames as ``n`` contract rows need; ``prev`` has the column ``_bucket``
    (null in versions that were stored without it)."""
    passes = min(MONTH_BUCKETS, max(1, -(-n // PASS_ROWS)))
    out = []
    for k in range(passes):
        some = list(range(k, MONTH_BUCKETS, passes))
        mine = _bucket_of("ContractID").isin(some) if passes > 1 else F.lit(True)
        if prev is None:
            months, _ = R.upsert_client_month(table, rows.filter(mine), as_of, target_empty=True)
        else:
            held = prev.filter((F.col(_BUCKET).isin(some) | F.col(_BUCKET).isNull()) & mine).drop(_BUCKET)
            months, _ = R.upsert_client_month(held, rows.filter(mine), as_of)
            months = months.repartition("ClientID", "ContractID")  # as after a first load, where nothing is joined
        out.append(months.withColumn(_BUCKET, _bucket_of("ContractID")))
    return out


def _summary_source(spark: SparkSession, root: str, run: int, src: DataFrame) -> DataFrame:
    """R1's rows, stored while U4 reads them: they are computed once, and their shuffles are gone before U4's begin."""
    sinks.write_snapshot(src, f"{root}/_ContractSource", run)
    drop_finished_shuffles(spark)
    return sinks.read_snapshot(spark, f"{root}/_ContractSource")


def run_revenue(spark: SparkSession, root: str, contracts: DataFrame, clients: DataFrame, services: DataFrame,
                units: DataFrame, tickets: DataFrame, as_of) -> dict:
    """R1 -> U4 -> R2 -> R4 + R3 -> R6 -> R7 -> U5, one snapshot per stored table.

    R8: when the stored contract summary or ticket counts are empty the run is skipped.

    The months of a contract lie together (by ``MONTH_BUCKETS`` hash buckets, sorted by key), which packs them well, and are
    merged bucket by bucket, so the shuffles of all months are never on the disks at once.
    """
    summary_t, month_t = f"{root}/ContractSummary", f"{root}/ClientMonthlySummary"
    sv = _next_version(spark, summary_t)
    src = _summary_source(spark, root, sv, R.contract_summary(contracts, clients, services, units))
    prev = sinks.read_snapshot(spark, summary_t)
    if prev is None:
        summary, _ = R.upsert_contract_summary(R.summary_table_schema(src), src, as_of, target_empty=True)
    else:
        summary, _ = R.upsert_contract_summary(prev, src, as_of)
    sinks.write_snapshot(summary, summary_t, sv)
    sinks.remove(spark, f"{root}/_ContractSource")
    drop_finished_shuffles(spark)
    summary = sinks.read_snapshot(spark, summary_t)  # lineage cut: later steps read the stored table
    # Stored first, then tested, so that the join runs once.
    count_t = f"{root}/TicketCounts"
    sinks.write_snapshot(R.tickets_per_contract_month(tickets, summary), count_t, sv)
    drop_finished_shuffles(spark)
    counts = sinks.read_snapshot(spark, count_t)
    if not R.has_rows(summary) or not R.has_rows(counts):
        return {"skipped": True, "ContractSummary": sv}
    rows = R.revenue_rows(summary, counts, as_of)
    table = R.client_month_table(rows)
    prev_m = sinks.read_snapshot(spark, month_t, schema=T.StructType([*table.schema.fields, T.StructField(_BUCKET, T.IntegerType())]))
    mv = _next_version(spark, month_t)
    sinks.write_snapshot_parts(_month_passes(rows, prev_m, table, summary.count(), as_of), month_t, mv, [_BUCKET],
                               ["ClientID", "ContractID", "RevenueMonth"])
    return {"skipped": False, "ContractSummary": sv, "ClientMonthlySummary": mv}


SUMMARY_PARTS = 64  # hash buckets of contracts in the refreshed ContractSummary; fixed for a table's life


def refresh_revenue(spark: SparkSession, root: str, contracts: DataFrame, clients: DataFrame, services: DataFrame,
                    units: DataFrame, tickets: DataFrame, as_of, summary_parts: int = SUMMARY_PARTS) -> dict:
    """R9 by change sets (U4, U5): the tables of ``run_revenue``, of which a run reads and rewrites only the
    buckets of contracts and the months whose source rows differ from those of the run before.

    ``client_months`` reads the months, with the same rows and stamps that full runs would have stored."""
    run = _next_version(spark, f"{root}/ContractSummary/manifest")
    src = _summary_source(spark, root, run, R.contract_summary(contracts, clients, services, units))
    bucket = F.pmod(F.xxhash64("ContractID"), F.lit(summary_parts)).cast("string")
    summary = part_table.refresh(f"{root}/ContractSummary", src.withColumn("_part", bucket), [*R.SUMMARY_COLS, "_part"],
                                 ["ContractID", "ServiceID"], ["StartDate", "UnitID"], "_part", as_of)
    sinks.remove(spark, f"{root}/_ContractSource")
    stored = part_table.read(spark, f"{root}/ContractSummary", "_part", _summary_schema(src)).drop("_part")
    count_t = f"{root}/TicketCounts"
    sinks.write_snapshot(R.tickets_per_contract_month(tickets, stored), count_t, summary["run"])
    drop_finished_shuffles(spark)
    counts = sinks.read_snapshot(spark, count_t)
    if not R.has_rows(stored) or not R.has_rows(counts):  # R8
        return {"skipped": True, "ContractSummary": summary}
    rows = R.revenue_rows(stored, counts, as_of)
    months = part_table.refresh(f"{root}/ClientMonthlySummary", rows, R.MONTHLY_COLS, ["ClientID", "ContractID", "RevenueMonth"],
                                ["ServiceID"], "RevenueMonth", as_of, stamp_when_repeated=True,
                                first_cols=["ClientName", "ContractName", "ServiceID", "ServiceName"], pass_by=["ContractID"])
    return {"skipped": False, "ContractSummary": summary, "ClientMonthlySummary": months}


def _summary_schema(src: DataFrame) -> str:
    return ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in R.SUMMARY_COLS) + ", `_part` string"


MONTHLY_SCHEMA = ("ClientID string, ClientName string, ContractID string, ContractName string, ServiceID bigint, "
                  "ServiceName string, RevenueMonth string, MonthlyRevenue double, TicketsCreated bigint")


def client_months(spark: SparkSession, root: str) -> DataFrame | None:
    """ClientMonthlySummary as ``refresh_revenue`` stored it, or None."""
    return part_table.read(spark, f"{root}/ClientMonthlySummary", "RevenueMonth", MONTHLY_SCHEMA)


def run_kpis(spark: SparkSession, root: str, tickets: DataFrame, resources: DataFrame, entries: DataFrame,
             calls: DataFrame, csat: DataFrame, endpoints: DataFrame, uptime: DataFrame, as_of,
             events_as_of=None) -> dict:
    """K14 (+ S4, K12, K13, U6): register the KPI names, then run one guarded job for each source: it
    computes and writes its own rows, so an error in a source's plan *or data* costs its KPIs alone. The
    outcome of every source is stored in ``kpi_run_status``."""
    events_as_of = events_as_of or as_of
    reg_t, val_t, util_t, st_t = (f"{root}/kpis", f"{root}/kpi_values", f"{root}/ResourceUtilization",
                                  f"{root}/kpi_run_status")
    existing = sinks.read_snapshot(spark, reg_t)
    if existing is None:
        existing = spark.createDataFrame([], "id bigint, name string, description string, category string, type string")
    rv = _next_version(spark, reg_t)
    sinks.write_snapshot(KP.kpi_register(existing), reg_t, rv)
    registry = sinks.read_snapshot(spark, reg_t)
    # A run owns the partitions (date, run, source) it writes, so a replay replaces its own rows.
    run_id = _run_id(as_of)

    def store(source: str, rows: DataFrame) -> None:
        values = KP.kpi_values(registry, rows, as_of).withColumn("run_id", run_id).withColumn("source", F.lit(source))
        sinks.replace_partitions(values, val_t, ["date_recorded", "run_id", "source"],
                                 {"date_recorded": str(as_of)[:10], **_owned(as_of), "source": source})

    def utilization() -> None:
        # Stored first, by week; a run reads and replaces its own week only, and the KPI rows come from it.
        urows = KP.utilization_rows(KP.weekly_utilization(entries, resources, as_of))
        week = KP.week_start(F.lit(as_of).cast("timestamp_ntz"))
        if sinks.exists(spark, util_t):
            prev = (spark.read.schema(urows.schema).parquet(util_t).filter(F.col("weekStartDate") == week)
                    .select(*urows.columns))
            ensure_checkpoint_dir(spark)  # the partition read is the one replaced: cut the lineage first
            urows = KP.upsert_utilization(prev, KP.weekly_utilization(entries, resources, as_of))[0].checkpoint()
        sinks.replace_partitions(urows, util_t, ["weekStartDate"])  # rows stay while their week has entries
        now = spark.read.schema(urows.schema).parquet(util_t).filter(F.col("weekStartDate") == week)
        store("utilization", KP.utilization_kpis(now.select(
            F.col("resourceID").alias("user_id"), F.col("utilizationPercentage").alias("utilization_percentage"))))

    jobs: dict[str, Callable[[], None]] = {
        name: lambda name=name, build=build: store(name, build().withColumn("resource_id", F.lit(None).cast("bigint")))
        for name, build in KP.kpi_sources(tickets, calls, csat, endpoints, uptime, as_of, events_as_of).items()}
    jobs["utilization"] = utilization
    jobs["response"] = lambda: store("response", KP.response_kpis(KP.weekly_response_resolution(tickets, resources, as_of)))
    status = run_isolated(jobs, as_of)
    rows = spark.createDataFrame(status, "source string, status string, error string, as_of string")
    sinks.replace_partitions(rows.withColumn("run_id", run_id), st_t, ["run_id"])
    return {"status": status, "kpis": rv}


def _run_id(as_of):
    return F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyyMMddHHmmss")


def _owned(as_of) -> dict[str, str]:
    """The run's own partition, as its folder is named."""
    return {"run_id": "".join(c for c in str(as_of)[:19] if c.isdigit())}


def append_command_log(log: DataFrame, root: str, as_of: dt.datetime | str) -> None:
    """I8: audit rows by day and run; a replayed run replaces its own rows."""
    day = F.lit(as_of).cast("timestamp_ntz").cast("date")
    sinks.replace_partitions(log.withColumn("logged_date", day).withColumn("run_id", _run_id(as_of)),
                             f"{root}/CommandLogs", ["logged_date", "run_id"], {"logged_date": str(as_of)[:10], **_owned(as_of)})


def store_policies(policies: DataFrame, requirements: DataFrame, root: str, as_of: dt.datetime | str) -> None:
    """Policy headers and requirement rows by run; a replayed run replaces its own rows."""
    sinks.replace_partitions(policies.withColumn("run_id", _run_id(as_of)), f"{root}/Policies", ["run_id"], _owned(as_of))
    sinks.replace_partitions(requirements.withColumn("run_id", _run_id(as_of)), f"{root}/PolicyRequirements", ["run_id"], _owned(as_of))


def ingest_policies(spark: SparkSession, root: str, pages: DataFrame, answer: Callable[[DataFrame], DataFrame],
                    as_of: dt.datetime | str, tenant_id: int = 1) -> DataFrame:
    """Pages -> N1 text -> N2 chunks -> N9 requests -> ``answer`` -> N3/N4 requirements -> I11 stores.

    ``answer`` turns the request table into ``doc_id``, ``answer`` rows (the model calls themselves are
    the caller's batch job). Returns doc_id, policyId and the number of requirements of every document.
    """
    text = D.document_text(pages)
    requests = D.chat_requests(D.chunk_documents(text))
    found, _ = D.parse_requirements(answer(requests))
    store_policies(D.policy_headers(text, as_of, tenant_id=tenant_id), D.requirement_rows(found, as_of), root, as_of)
    stored = spark.read.parquet(f"{root}/PolicyRequirements").filter(F.col("run_id") == _run_id(as_of))
    return (D.policy_counts(text, stored, tenant_id=tenant_id)
            .select("doc_id", F.col("policy_id").alias("policyId"), "requirement_count"))
