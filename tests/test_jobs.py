"""Whole jobs writing snapshots."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from deskline.plans import jobs
from deskline.plans.q_contracts import time_entries_current, units_current
from deskline.session import scratch_dir
from deskline.sources import sinks
from deskline.sources.fixtures import AS_OF_DESK, AS_OF_EVENTS, views


def _key(df):
    return sorted(tuple(r) for r in df.collect())


def test_revenue_job_twice(spark, sf_dir):
    root = scratch_dir(spark, "t-revenue")
    v = views(spark, sf_dir, "contracts", "clients", "contract_services", "tickets")
    args = (v["contracts"], v["clients"], v["contract_services"], units_current(spark, sf_dir), v["tickets"])
    first = jobs.run_revenue(spark, root, *args, AS_OF_DESK)
    assert first == {"skipped": False, "ContractSummary": 0, "ClientMonthlySummary": 0}
    expected = E.queries()["upsert_client_month"](spark, sf_dir)
    stored = sinks.read_snapshot(spark, f"{root}/ClientMonthlySummary", schema=expected.schema)
    assert _key(stored.select(*expected.columns)) == _key(expected)
    second = jobs.run_revenue(spark, root, *args, AS_OF_DESK)
    assert second["ClientMonthlySummary"] == 1
    summ = sinks.read_snapshot(spark, f"{root}/ContractSummary")
    # second run: every key already existed, so LastUpdated is set on all of them (U4)
    assert summ.filter(F.col("LastUpdated").isNull()).count() == 0
    months = sinks.read_snapshot(spark, f"{root}/ClientMonthlySummary", schema=expected.schema)
    assert months.count() == stored.count() and months.filter(F.col("LastUpdated").isNull()).count() == 0


def test_revenue_job_skips_on_empty_input(spark, sf_dir):
    root = scratch_dir(spark, "t-revenue-empty")
    v = views(spark, sf_dir, "contracts", "clients", "contract_services", "tickets")
    out = jobs.run_revenue(spark, root, v["contracts"], v["clients"], v["contract_services"],
                           units_current(spark, sf_dir), v["tickets"].limit(0), AS_OF_DESK)
    assert out["skipped"] is True and sinks.read_snapshot(spark, f"{root}/ClientMonthlySummary") is None


def test_kpi_job_isolates_failures(spark, sf_dir):
    root = scratch_dir(spark, "t-kpis")
    v = views(spark, sf_dir, "tickets", "resources", "call_logs", "csat_responses", "endpoints", "system_uptime")
    broken_calls = v["call_logs"].drop("direction")  # the support-call KPI cannot be built
    out = jobs.run_kpis(spark, root, v["tickets"], v["resources"], time_entries_current(spark, sf_dir), broken_calls,
                        v["csat_responses"], v["endpoints"], v["system_uptime"], AS_OF_DESK, AS_OF_EVENTS)
    st = {name: s for name, s, _, _ in out["status"]}
    assert {n for n, s in st.items() if s == "failed"} == {"calls"} and len(st) == 8
    vals = spark.read.parquet(f"{root}/kpi_values")
    assert vals.filter(F.col("resource_id").isNull()).count() == 8  # all team KPIs but the broken one
    n_first = vals.count()
    out2 = jobs.run_kpis(spark, root, v["tickets"], v["resources"], time_entries_current(spark, sf_dir),
                         v["call_logs"], v["csat_responses"], v["endpoints"], v["system_uptime"], AS_OF_DESK,
                         AS_OF_EVENTS)
    assert {s for _, s, _, _ in out2["status"]} == {"ok"}
    # the same run replayed replaces its own partition (D28): only the second run's rows remain
    vals2 = spark.read.parquet(f"{root}/kpi_values")
    assert vals2.count() == n_first + 1
    assert vals2.select("run_id").distinct().count() == 1
    n_team = vals2.filter(F.col("resource_id").isNull()).count()
    assert n_team == 9
    reg = sinks.read_snapshot(spark, f"{root}/kpis")
    assert reg.count() == reg.select("name", "category", "type").distinct().count() == 12
    assert spark.read.parquet(f"{root}/kpi_run_status").count() == 8  # the replay replaced its own
    util = spark.read.parquet(f"{root}/ResourceUtilization")
    assert util.count() == util.select("resourceID", "weekStartDate").distinct().count() > 0


def test_append_sinks(spark, sf_dir):
    from deskline.operators import commands as C
    from deskline.operators import documents as N
    from deskline.sources.fixtures import load_table, view
    root = scratch_dir(spark, "t-sinks")
    log = C.command_log(C.route_commands(view(spark, sf_dir, "command_messages"))
                        .join(view(spark, sf_dir, "command_results"), "event_id"))
    jobs.append_command_log(log, root, AS_OF_DESK)
    jobs.append_command_log(log, root, "1998-06-18 10:00:00")
    stored = spark.read.parquet(f"{root}/CommandLogs")
    assert stored.count() == 2 * log.count() and stored.select("logged_date").distinct().count() == 2
    rows, _ = N.parse_requirements(view(spark, sf_dir, "policy_answers"))
    policies = N.policy_counts(load_table(spark, sf_dir, "documents"), rows)
    for _ in range(2):  # a replay replaces its own rows
        jobs.store_policies(policies, N.requirement_rows(rows, AS_OF_DESK), root, AS_OF_DESK)
    assert spark.read.parquet(f"{root}/Policies").count() == policies.count()
    assert spark.read.parquet(f"{root}/PolicyRequirements").count() == rows.count()
