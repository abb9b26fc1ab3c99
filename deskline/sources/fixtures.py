"""Service-desk views derived from the driver's Parquet tables.

Each view is one portable SQL text that Spark SQL and DuckDB both run, so the Spark operators
and the DuckDB oracle start from identical rows. Base tables are registered from ``sf_dir``.

The two feed views (``contract_unit_rows``, ``time_entry_rows``) carry their arrival order as
plain columns (``arr_*``; compare them lexicographically within one id) instead of a global
``row_number()``: a window without a partition would pull the whole feed through one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Literal `as_of` stamps used by the registered queries.
AS_OF_DESK = "1998-06-17 15:30:00"  # a Wednesday
AS_OF_SUNDAY = "1998-06-21 09:00:00"
AS_OF_EVENTS = "2024-02-10 06:00:00"

# Arrival order inside one id for both feeds (lineitem columns, compared left to right).
ARRIVAL_COLS = ["arr_shipdate", "arr_partkey", "arr_suppkey", "arr_extendedprice", "arr_discount",
                "arr_tax", "arr_returnflag", "arr_linestatus"]
_ARRIVAL_SELECT = ("l_shipdate AS arr_shipdate, l_partkey AS arr_partkey, l_suppkey AS arr_suppkey, "
                   "l_extendedprice AS arr_extendedprice, l_discount AS arr_discount, l_tax AS arr_tax, "
                   "l_returnflag AS arr_returnflag, l_linestatus AS arr_linestatus")

VIEWS: dict[str, tuple[list[str], str]] = {
    "status_codes": ([], """
SELECT * FROM (VALUES (0,1),(1,5),(2,7),(3,11),(4,21),(5,24),(6,28),(7,29),(8,32),(9,36),(10,41),(11,54),(12,56),(13,64),(14,70),(15,71),(16,74),(17,38),(18,69),(19,99)) AS v(k, status)
"""),
    "queue_codes": ([], """
SELECT * FROM (VALUES (0,8),(1,29683537),(2,29683539),(3,29683540),(4,29683555),(5,29683506),(6,29683552),(7,29683546),(8,29683535)) AS v(k, queueID)
"""),
    "tickets": (["status_codes", "queue_codes"], """
SELECT o_orderkey AS id,
       concat('Ticket ', CAST(o_orderkey AS STRING)) AS title,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN repeat('long text ', 30) ELSE 'short text' END AS description,
       o_custkey AS companyID,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey * 10 + o_orderkey % 3 END AS contactID,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 120 END AS assignedResourceID,
       CAST(q.queueID AS BIGINT) AS queueID,
       CAST(s.status AS INT) AS status,
       CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority,
       CAST(o_orderkey % 6 + 1 AS INT) AS issueType,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 15 AS INT) END AS subIssueType,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Support Desk' ELSE 'Projects' END AS category,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS serviceLevelAgreementHasBeenMet,
       o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 37 % 86400) AS createDate,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 37 % 86400 + o_orderkey % 20000) END AS firstResponseDateTime,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 37 % 86400 + 7200) END AS firstResponseDueDateTime,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 37 % 86400 + o_orderkey * 3 % 90000) END AS resolutionPlanDateTime,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 37 % 86400 + 28800) END AS resolutionPlanDueDateTime,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 37 % 86400 + o_orderkey * 11 % 600000) END AS resolvedDateTime,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 37 % 86400 + 259200) END AS resolvedDueDateTime
FROM orders
LEFT JOIN status_codes s ON s.k = o_orderkey % 20
LEFT JOIN queue_codes q ON q.k = o_orderkey % 10
"""),
    "resources": ([], """
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE concat('user', CAST(s_suppkey AS STRING), '@example.com') END AS email,
       concat('First', CAST(s_suppkey AS STRING)) AS first_name, s_name AS last_name
FROM supplier
"""),
    "clients": ([], """
SELECT c_custkey AS id, c_name AS companyName FROM customer
"""),
    "contracts": ([], """
SELECT o_orderkey AS id, concat('Contract ', CAST(o_orderkey AS STRING)) AS contractName, o_custkey AS companyID,
       CAST(o_orderkey % 3 AS INT) AS billingPreference
FROM orders
"""),
    "contract_services": ([], """
SELECT o_orderkey * 4 + v.k AS id, o_orderkey AS contractID,
       CASE WHEN (o_orderkey + v.k) % 7 = 0 THEN NULL ELSE concat('Service ', CAST(v.k AS STRING)) END AS internalDescription
FROM orders CROSS JOIN (VALUES (0),(1),(2)) AS v(k)
"""),
    "contract_unit_rows": ([], f"""
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS contractID, l_orderkey * 4 + l_linenumber % 4 AS serviceID,
       l_shipdate AS startDate,
       CASE WHEN l_partkey % 12 = 0 THEN NULL ELSE l_shipdate + INTERVAL '1' DAY * (l_partkey % 420 - 20) END AS endDate,
       CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS units,
       l_extendedprice * 0.5 AS unitCost, l_extendedprice AS unitPrice,
       CASE WHEN l_partkey % 15 = 0 THEN NULL ELSE l_extendedprice * 0.01 END AS internalCurrencyPrice,
       concat('invoice ', CAST(l_linenumber AS STRING)) AS invoiceDescription,
       {_ARRIVAL_SELECT}
FROM lineitem
"""),
    "time_entry_rows": ([], f"""
SELECT l_orderkey * 10 + l_linenumber AS id,
       CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_orderkey END AS contractID,
       l_suppkey + CASE WHEN l_linenumber = 7 THEN 1000 ELSE 0 END AS creatorUserID,
       l_suppkey AS resourceID, l_shipdate AS dateWorked,
       l_quantity / 10 AS hoursWorked, l_quantity * (1 - l_discount) / 10 AS hoursToBill,
       l_returnflag = 'R' AS isNonBillable,
       CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_shipdate + INTERVAL '1' HOUR * (l_partkey % 24) END AS lastModifiedDateTime,
       l_orderkey AS ticketID, CAST(l_linenumber AS INT) AS timeEntryType,
       {_ARRIVAL_SELECT}
FROM lineitem
"""),
    "devices": ([], """
SELECT p_partkey AS part_id,
       CASE WHEN p_partkey % 40 = 0 THEN '' ELSE concat('DEV-', CAST(p_partkey AS STRING)) END AS device_name,
       CASE p_partkey % 25 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE p_brand END AS manufacturer_name,
       p_partkey % 12 IN (0,1,2,4) OR (p_partkey % 12 > 4 AND p_size % 2 = 1) AS Datto_RMM,
       p_partkey % 12 IN (0,1,2) OR (p_partkey % 12 > 4 AND p_size % 3 = 1) AS Huntress,
       p_partkey % 12 IN (0,2) OR (p_partkey % 12 > 4 AND p_size % 5 = 1) AS Workstation_AD,
       p_partkey % 12 = 1 OR (p_partkey % 12 > 4 AND p_size % 7 = 1) AS Server_AD,
       p_partkey % 12 IN (0,1,2) OR (p_partkey % 12 > 4 AND p_size % 4 = 3) AS ImmyBot,
       p_partkey % 12 = 2 OR (p_partkey % 12 > 4 AND p_size % 11 = 1) AS Auvik,
       p_partkey % 12 IN (0,1,2) OR (p_partkey % 12 > 4 AND p_size % 13 = 1) AS CyberCNS,
       p_partkey % 12 IN (0,1,2) OR (p_partkey % 12 > 4 AND p_size % 6 = 5) AS ITGlue,
       p_size % 9 = 0 AS Inactive_Computer,
       p_name AS Name, concat('user', CAST(p_size AS STRING)) AS LastLoggedOnUser, 'N/A' AS IPv4Address, p_type AS OperatingSystem,
       'N/A' AS antivirusProduct, 'N/A' AS antivirusStatus, 'N/A' AS lastReboot, 'N/A' AS lastSeen, 'N/A' AS patchStatus, 'N/A' AS warrantyDate,
       CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS rebootRequired,
       CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS STRING) END AS datto_id, CAST(NULL AS STRING) AS huntress_id, CAST(NULL AS STRING) AS immy_id,
       CAST(NULL AS STRING) AS auvik_id, 'N/A' AS cybercns_id, CAST(NULL AS STRING) AS itglue_id,
       p_type AS device_model_name, concat('SN', CAST(p_partkey AS STRING)) AS serial_number
FROM part
"""),
    "device_flags_raw": ([], """
SELECT p_partkey AS part_id, CASE p_size % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'true' WHEN 3 THEN 'false' END AS flag_txt,
       CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'N/A' ELSE 'maybe' END AS reboot_txt
FROM part
"""),
    "uploads": ([], """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN replace('{"attachments":[{"contentType":"application/pdf","contentUrl":"u1-EVENT"}]}', 'EVENT', CAST(event_id AS STRING)) WHEN 1 THEN replace('{"attachments":[],"value":{"attachments":[{"contentType":"application/pdf","contentUrl":"u2-EVENT"}]}}', 'EVENT', CAST(event_id AS STRING))
       WHEN 2 THEN replace('{"value":{"attachments":[{"contentType":"image/png","contentUrl":"u3-EVENT"}]}}', 'EVENT', CAST(event_id AS STRING)) WHEN 3 THEN replace('{"attachments":[{"contentType":"application/pdf","contentUrl":"u4-EVENT"},{"contentType":"application/pdf","contentUrl":"u5-EVENT"}]}', 'EVENT', CAST(event_id AS STRING))
       WHEN 4 THEN '{}' ELSE '{"value":{}}' END AS payload
FROM events
"""),
    "endpoints": ([], """
SELECT p_partkey AS endpoint_id, CAST(p_size % 4 AS INT) AS patches_missing FROM part
"""),
    "system_uptime": ([], """
SELECT event_id, 100 - value / 100 AS uptime_percentage, ts AS recorded_date FROM events WHERE event_type = 'view'
"""),
    "call_logs": ([], """
SELECT event_id AS call_id, CASE WHEN event_type IN ('click','view') THEN 'Inbound' ELSE 'Outbound' END AS direction,
       CASE WHEN event_id % 3 = 0 THEN 'Support' ELSE 'Sales' END AS category
FROM events
"""),
    "csat_responses": ([], """
SELECT event_id, CAST(event_id % 5 + 1 AS INT) AS score, ts AS response_date FROM events WHERE event_type = 'signup'
"""),
    "ticket_envelopes": ([], """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{"other":1}' WHEN 1 THEN '{"my_ticket":5}' WHEN 2 THEN '{"my_ticket":[]}'
       WHEN 3 THEN concat('{"my_ticket":[{"id":', CAST(event_id AS STRING), ',"queueID":29683537,"title":"T ', event_type, '","status":', CAST(event_id % 30 AS STRING), ',"priority":', CAST(user_id % 4 + 1 AS STRING), ',"companyID":', CAST(user_id AS STRING), ',"description":"from ', CAST(user_id AS STRING), '","createDate":"2024-01-0', CAST(event_id % 9 + 1 AS STRING), 'T0', CAST(user_id % 9 AS STRING), ':15:00Z","resolvedDueDateTime":"soon"}]}')
       ELSE concat('{"my_ticket":[{"id":', CAST(event_id AS STRING), ',"queueID":8},{"id":', CAST(event_id + 100000 AS STRING), ',"queueID":29683506}]}') END AS body
FROM events
"""),
    "mixed_envelopes": ([], """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('{"my_ticket":[{"id":', CAST(event_id AS STRING), '}]} ', event_type)
       WHEN 1 THEN concat('{"my_ticket":[{"id":"', event_type, '"},{"id":', CAST(event_id AS STRING), ',"queueID":8}]}')
       WHEN 2 THEN concat('{"my_ticket":[', CAST(user_id AS STRING), ',{"id":', CAST(event_id AS STRING), ',"more":{"a":[1]}}]}')
       WHEN 3 THEN concat('{"my_ticket":[null,{"title":"', event_type, '"},[]]}') WHEN 4 THEN concat('{"other":[', CAST(user_id AS STRING), ']}')
       WHEN 5 THEN '{"my_ticket":[]}' WHEN 6 THEN concat('{"my_ticket":{"id":', CAST(event_id AS STRING), '}}')
       ELSE concat('{"my_ticket":[{"id":', CAST(event_id AS STRING), ',"queueID":', CAST(user_id AS STRING), '},{"id":', CAST(event_id + 100000 AS STRING), '}]}') END AS body
FROM events
"""),
    "command_messages": ([], """
SELECT event_id, CASE event_type WHEN 'click' THEN concat('  AskBot what is ', CAST(event_id AS STRING), ' ') WHEN 'view' THEN 'GetNextTicket' WHEN 'error' THEN ' mytickets'
       WHEN 'signup' THEN 'ReviewInsurance now' ELSE '   ' END AS message,
       CASE WHEN event_id % 20 = 0 THEN NULL ELSE concat('aad-', CAST(user_id AS STRING)) END AS aad_object_id,
       'https://svc.example' AS service_url, concat('conv-', CAST(event_id % 50 AS STRING)) AS conversation_id
FROM events
"""),
    "command_results": ([], """
SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN concat('Answer to "', event_type, '" no. ', CAST(user_id AS STRING)) END AS response,
       CASE WHEN event_id % 5 <> 0 THEN concat('[{"ticket_id":', CAST(event_id AS STRING), ',"title":"Ticket ', CAST(event_id AS STRING), '","points":', CAST(user_id % 90 AS STRING), '}]') END AS tickets
FROM events
"""),
    "payload_texts": ([], """
SELECT event_id, CASE event_id % 12
       WHEN 0 THEN concat('{"id":', CAST(event_id AS STRING), '}') WHEN 1 THEN concat('[', CAST(user_id AS STRING), ',{"a":[1,2]},null]')
       WHEN 2 THEN concat('{bad ', CAST(event_id AS STRING)) WHEN 3 THEN concat('{"a":', CAST(user_id AS STRING), '} x')
       WHEN 4 THEN concat('[1,', CAST(event_id AS STRING)) WHEN 5 THEN concat(chr(10), chr(9), '[', CAST(event_id AS STRING), ']', chr(10))
       WHEN 6 THEN CAST(event_id AS STRING) WHEN 7 THEN concat('"', event_type, '"') WHEN 8 THEN '' WHEN 9 THEN NULL
       WHEN 10 THEN concat('{"a":1},{"b":', CAST(event_id AS STRING), '}') ELSE concat('[1],[', CAST(event_id AS STRING), ']') END AS payload
FROM events
"""),
    "stamps": ([], """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat(d, 'T', t, 'Z') WHEN 1 THEN concat(d, 'T', t, '.250Z') WHEN 2 THEN d WHEN 3 THEN substring(d, 1, 4)
       WHEN 4 THEN concat('bad ', CAST(user_id AS STRING)) WHEN 5 THEN '' WHEN 6 THEN concat(d, 'T', t) END AS txt
FROM (SELECT event_id, user_id,
             concat(CAST(2000 + event_id % 41 AS STRING), '-', lpad(CAST(event_id % 13 AS STRING), 2, '0'), '-', lpad(CAST(event_id % 32 AS STRING), 2, '0')) AS d,
             concat(lpad(CAST(user_id % 25 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':', lpad(CAST(user_id % 60 AS STRING), 2, '0')) AS t
      FROM events) made
"""),
    "policy_pages": ([], """
SELECT conv_id AS doc_id, turn AS page_no, text FROM conversations
"""),
    "model_replies": ([], """
SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN concat(text, chr(10), '```python', chr(10), 'x = ', CAST(turn AS STRING), chr(10), '``` after ```y```')
       ELSE concat(' ', text, ' ') END AS reply
FROM conversations
"""),
    "policy_answers": ([], """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('not json ', CAST(doc_id AS STRING)) WHEN 1 THEN '[]' WHEN 2 THEN '{"requirement":"bare object"}'
       WHEN 5 THEN concat(chr(10), chr(9), '[{"requirement":"keep ', CAST(n_chars AS STRING), ' days","category":"', source, '"}]', chr(10))
       WHEN 6 THEN concat('[{"requirement":"r', CAST(doc_id AS STRING), '"}] trailing') WHEN 7 THEN concat('[{"requirement":"cut ', CAST(doc_id AS STRING))
       WHEN 3 THEN concat('[{"requirement":"notify within ', CAST(doc_id % 72 AS STRING), ' hours","category":"coverage_condition"},{"requirement":"keep MFA"}]')
       ELSE '[{"requirement":"isolate hosts","category":"permitted"},{"requirement":"pay ransom","category":"prohibited"}]' END AS answer
FROM documents
"""),
}


# Spark texts for views whose portable SQL would plan badly in Spark: the same rows, with a
# generator instead of a cross join against a constant table.
SPARK_VIEWS: dict[str, str] = {
    "contract_services": """
SELECT o_orderkey * 4 + k AS id, o_orderkey AS contractID,
       CASE WHEN (o_orderkey + k) % 7 = 0 THEN NULL ELSE concat('Service ', CAST(k AS STRING)) END AS internalDescription
FROM orders LATERAL VIEW explode(array(0, 1, 2)) v AS k
""",
}


def view_order(names: list[str]) -> list[str]:
    """Views needed for ``names``, dependencies first."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n in BASE_TABLES:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (I10). Stamps arrive as zone-less ``timestamp_ntz``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bases(view_name: str) -> list[str]:
    sql = VIEWS[view_name][1]
    return [t for t in BASE_TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named views (and base tables), built from ``sf_dir`` with their dependencies."""
    built = {n: load_table(spark, sf_dir, n) for n in names if n in BASE_TABLES}
    for v in view_order(list(names)):
        for t in _bases(v):
            if t not in built:
                built[t] = load_table(spark, sf_dir, t)
            built[t].createOrReplaceTempView(t)
        for dep in VIEWS[v][0]:
            built[dep].createOrReplaceTempView(dep)
        built[v] = spark.sql(SPARK_VIEWS.get(v, VIEWS[v][1]))
    return {n: built[n] for n in names}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return views(spark, sf_dir, name)[name]


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """DuckDB oracle text: the needed views as CTEs ahead of ``body``.

    ``body`` either starts with ``SELECT`` or continues the CTE list with ``, name AS (...)``.
    """
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][1].strip()})" for v in view_order(names))
    body = body.strip()
    if not ctes:
        if not body.startswith(","):
            return body
        body = body[1:].lstrip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
