"""Hand-written rows for each decision and exact rule."""

import datetime as dt

from pyspark.sql import functions as F

from deskline.functions import (
    day_diff, display_time, hours_text, minute_diff, parse_iso, parse_strict_z, week_end, week_start,
)
from deskline.operators import commands as C
from deskline.operators import contracts as R
from deskline.operators import devices as V
from deskline.operators import documents as N
from deskline.operators import kpis as KP
from deskline.operators import tickets as T

D = dt.datetime
TICKET_SCHEMA = ("id bigint, companyID bigint, assignedResourceID bigint, queueID bigint, status int, priority int, "
                 "title string, description string, serviceLevelAgreementHasBeenMet boolean, createDate timestamp_ntz, "
                 "firstResponseDateTime timestamp_ntz, firstResponseDueDateTime timestamp_ntz, "
                 "resolutionPlanDateTime timestamp_ntz, resolutionPlanDueDateTime timestamp_ntz, "
                 "resolvedDateTime timestamp_ntz, resolvedDueDateTime timestamp_ntz")
AS_OF = "1998-06-17 15:30:00"


def ticket(i, company=1, queue=None, status=1, priority=1, create=D(1998, 6, 10), met=(None, None, None),
           due=(None, None, None), sla=None, title=None, desc=None, res=None):
    return (i, company, res, queue, status, priority, title or f"T{i}", desc, sla, create,
            met[0], due[0], met[1], due[1], met[2], due[2])


def tdf(spark, rows):
    return spark.createDataFrame(rows, TICKET_SCHEMA)


def one(df, col):
    return [r[col] for r in df.collect()]


# --- tickets ------------------------------------------------------------------------------------
def test_null_queue_kept_excluded_dropped(spark):
    df = tdf(spark, [ticket(1, queue=None), ticket(2, queue=29683506), ticket(3, queue=8)])
    assert sorted(one(T.exclude_queues(df), "id")) == [1, 3]


def test_weight_rules(spark):
    rows = [
        # priority 1 (5) + status 1 (50) + 3 misses (300) + 7 days (70)
        ticket(1, priority=1, status=1, create=D(1998, 6, 10, 15, 30)),
        # unknown status 99 -> 10, priority 4 -> 2 (labelled Critical but weighs 2, D21)
        ticket(2, priority=4, status=99, create=None),
        # all three SLAs met on time -> no penalty; created after as_of -> negative whole days (floor)
        ticket(3, priority=9, status=38, create=D(1998, 6, 18, 3, 0),
               met=(D(1998, 6, 18, 4), D(1998, 6, 18, 5), D(1998, 6, 18, 6)),
               due=(D(1998, 6, 18, 4), D(1998, 6, 19), D(1998, 6, 19))),
    ]
    w = {r["id"]: (r["weight"], r["sla_missed"]) for r in T.ticket_weight(tdf(spark, rows), AS_OF).collect()}
    assert w[1] == (5 + 50 + 300 + 70, 3)
    assert w[2] == (2 + 10 + 300 + 0, 3)
    assert w[3] == (0 - 400 + 0 - 10, 0)


def test_open_and_not_yet_due_both_miss(spark):
    rows = [ticket(1, met=(None, None, None), due=(D(1998, 6, 18), D(1998, 6, 16), None))]
    t = T.sla_results(tdf(spark, rows), AS_OF)
    s = t.collect()[0]["sla_results"]
    assert [x["sla_met"] for x in s] == [False, False, False]
    assert s[0]["time_left_seconds"] > 0 and s[1]["time_left_seconds"] < 0 and s[2]["time_left_seconds"] is None
    tl = T.sla_timeline(t, AS_OF).orderBy("pos").collect()
    assert [r["status_text"] for r in tl] == ["Not Yet Due", "Not Met", "Not Met"]
    assert [r["status_color"] for r in tl] == ["default", "attention", "attention"]
    assert tl[2]["time_status"] == "N/A" and tl[2]["due_date"] == "N/A" and tl[2]["met_date"] == "Not completed"


def test_tie_keeps_input_order(spark):
    rows = [ticket(5, company=1), ticket(3, company=1), ticket(4, company=2)]
    w = T.ticket_weight(tdf(spark, rows), AS_OF)
    best = {r["companyID"]: r["id"] for r in T.next_ticket(w, per=["companyID"]).collect()}
    assert best == {1: 3, 2: 4}
    assert one(T.next_ticket(w, per=None), "id") == [3]


def test_hours_text_half_up(spark):
    df = spark.createDataFrame([(18.0,), (-18.0,), (7218.0,), (0.0,)], "s double")
    assert one(df.select(hours_text("s").alias("h")), "h") == ["0.01", "0.01", "2.01", "0.00"]


def test_display_time_zones(spark):
    df = spark.createDataFrame([(D(1998, 6, 17, 15, 30),), (D(1998, 1, 17, 15, 5),), (None,)], "t timestamp_ntz")
    assert one(df.select(display_time("t").alias("d")), "d") == ["06-17-98 10:30 AM CDT", "01-17-98 9:05 AM CST", "N/A"]


def test_descriptions(spark):
    long = "x" * 250
    df = tdf(spark, [ticket(1, desc=long), ticket(2, desc=None), ticket(3, desc="short")])
    d = {r["id"]: r["description"] for r in T.ticket_detail(df, AS_OF).collect()}
    assert d[1] == "x" * 200 + "..." and d[2] == "" and d[3] == "short"
    m = {r["id"]: r["description"] for r in T.my_tickets(df).collect()}
    assert m[3] == "short..." and m[2] == "No description available...."


def test_labels(spark):
    df = tdf(spark, [ticket(1, priority=4, status=99), ticket(2, priority=7, status=70)])
    d = {r["id"]: r for r in T.ticket_detail(df, AS_OF).collect()}
    assert (d[1]["priority_text"], d[1]["priority_color"], d[1]["status_text"]) == ("Critical", "attention", "Status ID 99")
    assert (d[2]["priority_text"], d[2]["priority_color"], d[2]["status_text"]) == ("Unknown", "default", "Assigned")


def test_ticket_counts_null_group(spark):
    df = spark.createDataFrame([(1, None, 1, None), (1, 2, 1, None)],
                               "companyID bigint, contactID bigint, issueType int, subIssueType int")
    rows = {(r["dim"], r["value"]): r["ticket_count"] for r in T.ticket_counts(df).collect()}
    assert rows[("total", None)] == 2 and rows[("contactID", None)] == 1 and rows[("subIssueType", None)] == 2


# --- stamps -------------------------------------------------------------------------------------
def test_minute_and_day_boundaries(spark):
    df = spark.createDataFrame([(D(2024, 1, 1, 0, 0, 59), D(2024, 1, 1, 0, 1, 0))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(minute_diff("a", "b").alias("m"), day_diff("a", "b").alias("d")).collect()[0]
    assert (r["m"], r["d"]) == (1, 0)


def test_week_bounds_sunday_and_saturday(spark):
    df = spark.createDataFrame([(D(1998, 6, 21, 9),), (D(1998, 6, 17),)], "t timestamp_ntz")
    r = df.select(week_start("t").alias("s"), week_end("t").alias("e")).collect()
    # on a Sunday the *previous* Sunday starts the week
    assert (r[0]["s"], r[0]["e"]) == (dt.date(1998, 6, 14), dt.date(1998, 6, 20))
    assert (r[1]["s"], r[1]["e"]) == (dt.date(1998, 6, 14), dt.date(1998, 6, 20))


def test_saturday_noon_excluded(spark):
    rows = [ticket(1, create=D(1998, 6, 20, 0, 0), res=7), ticket(2, create=D(1998, 6, 20, 12, 0), res=7)]
    res = spark.createDataFrame([(7, "a@x")], "id bigint, email string")
    r = KP.weekly_response_resolution(tdf(spark, rows), res, AS_OF).collect()
    assert [x["ticket_count"] for x in r] == [1]


def test_parse_iso_guards(spark):
    vals = ["2024-01-05T01:02:03Z", "2024-01-05", "2024", "2024-1-5", "bad", "", None, "2024-01-05T01:02:03+02:00"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = one(df.select(parse_iso("t").cast("timestamp_ntz").alias("p")), "p")
    assert got == [D(2024, 1, 5, 1, 2, 3), D(2024, 1, 5), None, None, None, None, None, D(2024, 1, 4, 23, 2, 3)]


def test_parse_strict(spark):
    vals = ["2024-1-5T1:2:3Z", "2024-01-05T01:02:03.25Z", "2024-01-05T01:02:03", "2024-13-05T01:02:03Z"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = one(df.select(parse_strict_z("t").cast("timestamp_ntz").alias("p")), "p")
    assert got == [D(2024, 1, 5, 1, 2, 3), D(2024, 1, 5, 1, 2, 3, 250000), None, None]


# --- revenue ------------------------------------------------------------------------------------
def spine(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    return [str(x) for x in df.select(F.explode(R.month_spine(F.col("a"), F.col("b"))).alias("m")).toPandas()["m"]]


def test_spine_drift_and_guards(spark):
    # Jan 31 -> Feb 29 -> Mar 29: the walk lands on Mar 29 10:00, after Mar 29 09:00 -> March dropped
    assert spine(spark, D(2024, 1, 31, 10), D(2024, 3, 29, 9)) == ["2024-01-01", "2024-02-01"]
    assert spine(spark, D(2024, 1, 31, 10), D(2024, 3, 29, 10)) == ["2024-01-01", "2024-02-01", "2024-03-01"]
    assert spine(spark, D(2024, 3, 1), D(2024, 2, 1)) == []  # reversed range: no rows, no error
    assert spine(spark, None, D(2024, 2, 1)) == []


def test_fan_out_counting(spark):
    tickets = spark.createDataFrame([(1, 10, D(2024, 2, 10))], "id bigint, companyID bigint, createDate timestamp_ntz")
    summ = spark.createDataFrame([(10, 100, D(2024, 1, 1), D(2024, 12, 31)), (10, 100, D(2024, 2, 1), D(2024, 2, 28)),
                                  (10, 200, D(2024, 3, 1), None)],
                                 "CompanyID bigint, ContractID bigint, StartDate timestamp_ntz, EndDate timestamp_ntz")
    r = R.tickets_per_contract_month(tickets, summ).collect()
    assert [(x["ContractID"], x["TicketCount"]) for x in r] == [(100, 2)]  # once per covering row (D10)


# --- documents ----------------------------------------------------------------------------------
def chunks(spark, text, n):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return [r["chunk"] for r in N.chunk_documents(df, n).orderBy("chunk_no").collect()]


def test_chunker_rules(spark):
    assert chunks(spark, "", 10) == []
    assert chunks(spark, "abc\ndef\n", 10) == ["abc\ndef\n"]
    assert chunks(spark, "abcdefghijkl\nab", 10) == ["", "abcdefghijkl\n", "ab\n"]  # D27
    assert chunks(spark, "aaaa\nbbbb\ncccc", 10) == ["aaaa\nbbbb\n", "cccc\n"]
    assert chunks(spark, "a\r\nb\n\nc", 100) == ["a\nb\n\nc\n"]


def test_parse_requirements_rules(spark):
    df = spark.createDataFrame([(1, "not json"), (2, "[]"), (3, '{"requirement":"x"}'),
                                (4, '[{"requirement":"r1"},{"requirement":"r2","category":"permitted"}]')],
                               "doc_id bigint, answer string")
    rows, bad = N.parse_requirements(df)
    assert sorted(one(bad, "doc_id")) == [1, 3]
    assert [(r["requirement"], r["category"]) for r in rows.orderBy("req_no").collect()] == [
        ("r1", "general"), ("r2", "permitted")]


def test_split_fences(spark):
    df = spark.createDataFrame([(1, 1, " Hi\n```python\nx = 1\n``` bye ")], "conv_id bigint, turn bigint, reply string")
    parts = [(r["kind"], r["text"]) for r in N.split_fences(df).orderBy("part_no").collect()]
    assert parts == [("text", "Hi"), ("code", "```\nx = 1\n```"), ("text", "bye")]
    assert one(N.flatten_reply(df), "response_text") == ["Hi ```\nx = 1\n``` bye"]


# --- devices, commands --------------------------------------------------------------------------
def test_match_classes(spark):
    base = dict.fromkeys(["Datto_RMM", "Huntress", "Workstation_AD", "Server_AD", "ImmyBot", "Auvik", "CyberCNS",
                          "ITGlue"], False)
    full = {**base, "Datto_RMM": True, "Huntress": True, "Workstation_AD": True, "ImmyBot": True, "CyberCNS": True,
            "ITGlue": True}
    rows = [(1, "a", full), (2, "", {**full, "Auvik": True}), (3, None, {**base, "Huntress": True}), (4, "d", base)]
    cols = list(base)
    df = spark.createDataFrame([(i, n, *[f[c] for c in cols]) for i, n, f in rows],
                               "part_id bigint, device_name string, " + ", ".join(f"{c} boolean" for c in cols))
    got = {r["part_id"]: (r["device_name"], r["match_class"]) for r in V.device_match(df, "part_id").collect()}
    assert got == {1: ("a", "full"), 2: ("Unnamed Device", "partial"), 3: ("Unnamed Device", "single"), 4: ("d", None)}


def test_routing(spark):
    df = spark.createDataFrame([(1, "  AskBot What? ", "u", "s", "c"), (2, "GetNextTicket", None, "s", "c"),
                                (3, "hello", "u", "s", "c"), (4, "   ", "u", "s", "c")],
                               "event_id bigint, message string, aad_object_id string, service_url string, conversation_id string")
    got = {r["event_id"]: (r["command"], r["args"]) for r in C.route_commands(df).collect()}
    assert got == {1: ("askbot", "what?"), 2: ("invalid", None), 3: ("unknown", None), 4: ("invalid", None)}


def test_uploads(spark):
    pdf = '{"contentType":"application/pdf","contentUrl":"u"}'
    df = spark.createDataFrame([(1, f'{{"attachments":[{pdf}]}}'), (2, f'{{"attachments":[],"value":{{"attachments":[{pdf}]}}}}'),
                                (3, f'{{"attachments":[{pdf},{pdf}]}}'), (4, "{}")], "event_id bigint, payload string")
    got = {r["event_id"]: r["ok"] for r in C.valid_uploads(df).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


# --- upsert column policies ---------------------------------------------------------------------
def test_client_month_first_last_rule(spark):
    cols = ("ClientID string, ClientName string, ContractID string, ContractName string, ServiceID bigint, "
            "ServiceName string, RevenueMonth string, MonthlyRevenue double, TicketsCreated bigint")
    target = spark.createDataFrame([("c1", "Old", "k1", "K", 1, "S1", "2024-01-01", 5.0, 1, None)],
                                   cols + ", LastUpdated timestamp_ntz")
    rows = spark.createDataFrame([
        ("c1", "New", "k1", "K", 3, "S3", "2024-01-01", 30.0, 3),   # existing key: measures from the last row
        ("c1", "New", "k1", "K", 2, "S2", "2024-01-01", 20.0, 2),
        ("c2", "A", "k2", "K2", 7, "S7", "2024-01-01", 7.0, 0),      # new key, one row: no stamp
        ("c3", "B", "k3", "K3", 9, "S9", "2024-01-01", 9.0, 9),      # new key, two rows: first names, last measures
        ("c3", "B2", "k3", "K3", 8, "S8", "2024-01-01", 8.0, 8)], cols)
    snap, _ = R.upsert_client_month(target, rows, AS_OF)
    got = {r["ClientID"]: r for r in snap.collect()}
    assert (got["c1"]["ClientName"], got["c1"]["ServiceID"], got["c1"]["MonthlyRevenue"]) == ("Old", 1, 30.0)
    assert got["c1"]["LastUpdated"] == D(1998, 6, 17, 15, 30)
    assert got["c2"]["LastUpdated"] is None and got["c2"]["MonthlyRevenue"] == 7.0
    assert (got["c3"]["ClientName"], got["c3"]["ServiceID"], got["c3"]["MonthlyRevenue"]) == ("B2", 8, 9.0)
    assert got["c3"]["LastUpdated"] == D(1998, 6, 17, 15, 30)
    fresh, _ = R.upsert_client_month(target.limit(0), rows, AS_OF, target_empty=True)
    assert {r["ClientID"]: tuple(r) for r in fresh.collect() if r["ClientID"] != "c1"} == \
        {k: tuple(v) for k, v in got.items() if k != "c1"}


def test_contract_summary_stamp_only_on_match(spark):
    cols = ("ContractID bigint, ContractName string, CompanyID bigint, CompanyName string, ServiceID bigint, "
            "ServiceName string, StartDate timestamp_ntz, EndDate timestamp_ntz, Units double, UnitPrice double, "
            "Cost double, BillingPreference int, TotalRevenue double, TotalCost double")
    row = (1, "C", 7, "Co", 10, "S", D(2024, 1, 1), None, 1.0, 2.0, 2.0, 0, 2.0, 2.0)
    target = spark.createDataFrame([row + (None,)], cols + ", LastUpdated timestamp_ntz")
    src = spark.createDataFrame([row + (100,), (1, "C", 7, "Co", 11, "S", D(2024, 2, 1), None, 1.0, 3.0, 3.0, 0, 3.0, 3.0, 101),
                                 (1, "C", 7, "Co", 11, "S", D(2024, 3, 1), None, 1.0, 4.0, 4.0, 0, 4.0, 4.0, 99)],
                                cols + ", UnitID bigint")
    snap, _ = R.upsert_contract_summary(target, src, AS_OF)
    got = {r["ServiceID"]: r for r in snap.collect()}
    assert got[10]["LastUpdated"] == D(1998, 6, 17, 15, 30)
    assert got[11]["LastUpdated"] is None and got[11]["TotalRevenue"] == 4.0   # latest StartDate wins (D12)


def test_utilization_week_end_insert_only(spark):
    tgt = spark.createDataFrame([(5, "a@x", dt.date(1998, 6, 14), dt.date(1998, 6, 19), 8.0, 20.0)],
                                "resourceID bigint, emailAddress string, weekStartDate date, weekEndDate date, "
                                "totalHoursWorked double, utilizationPercentage double")
    weekly = spark.createDataFrame([("b@x", 5, 16.0, 40.0, dt.date(1998, 6, 14), dt.date(1998, 6, 20)),
                                    ("c@x", 6, 4.0, 10.0, dt.date(1998, 6, 14), dt.date(1998, 6, 20))],
                                   "emailAddress string, user_id bigint, total_hours double, "
                                   "utilization_percentage double, weekStartDate date, weekEndDate date")
    snap, _ = KP.upsert_utilization(tgt, weekly)
    got = {r["resourceID"]: r for r in snap.collect()}
    assert (got[5]["emailAddress"], got[5]["totalHoursWorked"], got[5]["weekEndDate"]) == ("b@x", 16.0, dt.date(1998, 6, 19))
    assert got[6]["weekEndDate"] == dt.date(1998, 6, 20)


def test_text_stamps_bad_vs_missing(spark):
    schema = ("id bigint, priority int, status int, createDate string, firstResponseDateTime string, "
              "firstResponseDueDateTime string, resolutionPlanDateTime string, resolutionPlanDueDateTime string, "
              "resolvedDateTime string, resolvedDueDateTime string")
    df = spark.createDataFrame([(1, 1, 1, "bad", "oops", "1998-06-18T00:00:00Z", "", "1998-06-18T00:00:00Z",
                                 "1998-06-17T10:00:00-05:00", "1998-06-17T16:00:00Z")], schema)
    s = T.sla_results(df, AS_OF).collect()[0]["sla_results"]
    # bad met stamp: not met, no seconds, 'N/A' / 'Not completed' even though the due date is valid
    assert (s[0]["sla_met"], s[0]["time_left_seconds"], s[0]["due_date_formatted"], s[0]["met_date_formatted"]) == \
        (False, None, "N/A", "Not completed")
    # empty met text is *missing*: open, seconds counted to as_of, due shown
    assert s[1]["sla_met"] is False and s[1]["time_left_seconds"] == 30600.0 and s[1]["due_date_formatted"] != "N/A"
    # offset kept: 10:00-05:00 = 15:00 UTC <= 16:00 UTC
    assert s[2]["sla_met"] is True and s[2]["time_left_seconds"] == 3600.0
    w = T.ticket_weight(df, AS_OF).collect()[0]
    assert (w["sla_missed"], w["weight"]) == (2, 5 + 50 + 200)   # bad create date adds no age points


def test_kpi_aging_drops_null_status_and_truncates_toward_zero(spark):
    rows = [
        # K2: old and open -> counted; null status -> dropped by NOT IN; excluded status -> dropped
        ticket(1, status=1, create=D(1998, 6, 1), queue=8),
        ticket(2, status=None, create=D(1998, 6, 1), queue=8),
        ticket(3, status=7, create=D(1998, 6, 1), queue=8),
        # K3: responses before creation: minute boundaries -1 and -2 -> avg -1.5 -> -1 (not floor -2)
        ticket(4, status=1, create=D(1998, 6, 17, 0, 1, 30), queue=8, met=(D(1998, 6, 17, 0, 0, 0), None, None)),
        ticket(5, status=1, create=D(1998, 6, 17, 0, 2, 0), queue=8, met=(D(1998, 6, 17, 0, 0, 0), None, None)),
    ]
    r = KP.desk_ticket_kpis(tdf(spark, rows), AS_OF).collect()[0]
    assert r["aging_over_5"] == 1
    assert r["avg_response_minutes"] == -1
    assert sorted(one(KP.aging_tickets(tdf(spark, rows), AS_OF), "id")) == [1]
