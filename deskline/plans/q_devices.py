"""Registered device-report queries (V1-V9, I13, B3-B5) and their oracle SQL."""

from __future__ import annotations

from deskline import constants as K
from deskline.operators import devices as V
from deskline.plans.registry import register
from deskline.session import ensure_session
from deskline.sources.fixtures import view, with_views

BATCH = 500


def _devices(spark, sf_dir):
    ensure_session(spark)
    return view(spark, sf_dir, "devices")


@register("device_summary", with_views(["devices"], """
SELECT part_id, Name AS device_name, Datto_RMM, Huntress, ITGlue AS IT_Glue, Workstation_AD, Server_AD, ImmyBot, Auvik,
       CyberCNS, Inactive_Computer, LastLoggedOnUser AS LastLoggedInUser, IPv4Address, OperatingSystem, antivirusProduct,
       antivirusStatus, lastReboot, lastSeen, patchStatus, rebootRequired, warrantyDate, datto_id, huntress_id, immy_id,
       auvik_id, cybercns_id, 'N/A' AS locationName, itglue_id, manufacturer_name, 'N/A' AS model_name, serial_number
FROM devices
"""))
def device_summary(spark, sf_dir):
    return V.device_summary(_devices(spark, sf_dir), key="part_id")


@register("device_totals", with_views(["devices"], """
SELECT CAST(count(*) AS BIGINT) AS total_devices, CAST(count(*) FILTER (WHERE Inactive_Computer) AS BIGINT) AS inactive_devices,
       CAST(0 AS BIGINT) AS no_antivirus, CAST(0 AS BIGINT) AS no_last_reboot
FROM devices
"""))
def device_totals(spark, sf_dir):
    return V.device_totals(_devices(spark, sf_dir))


@register("manufacturer_counts", with_views(["devices"], """
SELECT manufacturer_name, CAST(count(*) AS BIGINT) AS device_count FROM devices
WHERE manufacturer_name IS NOT NULL AND manufacturer_name <> '' AND manufacturer_name <> 'N/A'
GROUP BY manufacturer_name
"""))
def manufacturer_counts(spark, sf_dir):
    return V.manufacturer_counts(_devices(spark, sf_dir))


@register("integration_counts", with_views(["devices"], " UNION ALL ".join(
    f"SELECT '{n}' AS integration, CAST({i} AS INT) AS pos, CAST(count(*) FILTER (WHERE {n}) AS BIGINT) AS device_count FROM devices"
    for i, n in enumerate(K.INTEGRATIONS))))
def integration_counts(spark, sf_dir):
    return V.integration_counts(_devices(spark, sf_dir))


def _full_sql() -> str:
    conds = []
    for s in K.FULL_MATCH_SETS:
        conds.append("(" + " AND ".join(f"coalesce({n}, false)" if n in s else f"NOT coalesce({n}, false)"
                                         for n in K.INTEGRATIONS) + ")")
    return " OR ".join(conds)


_N = " + ".join(f"CAST(coalesce({n}, false) AS INT)" for n in K.INTEGRATIONS)
_MATCH = f"""
, m AS (SELECT part_id, CASE WHEN coalesce(device_name, '') = '' THEN 'Unnamed Device' ELSE device_name END AS device_name,
               concat_ws(', ', {", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in K.INTEGRATIONS)}) AS matched_integrations,
               CAST({_N} AS INT) AS n_integrations,
               CASE WHEN {_full_sql()} THEN 'full' WHEN {_N} = 1 THEN 'single' WHEN {_N} > 1 THEN 'partial' END AS match_class
        FROM devices)
"""


@register("device_match", with_views(["devices"], _MATCH + "SELECT * FROM m"))
def device_match(spark, sf_dir):
    return V.device_match(_devices(spark, sf_dir), "part_id")


@register("match_summary", with_views(["devices"], _MATCH + """
SELECT match_class, CAST(count(*) AS BIGINT) AS device_count FROM m WHERE match_class IS NOT NULL GROUP BY match_class
"""))
def match_summary(spark, sf_dir):
    return V.match_summary(V.device_match(_devices(spark, sf_dir), "part_id"))


_ISSUES = """
, iss AS (SELECT 'not_seen_recently' AS issue_type, part_id,
                 CASE WHEN coalesce(device_name, '') = '' THEN 'Unnamed Device' ELSE device_name END AS device_name
          FROM devices WHERE Inactive_Computer)
"""


@register("device_issues", with_views(["devices"], _ISSUES + "SELECT * FROM iss"))
def device_issues(spark, sf_dir):
    return V.device_issues(_devices(spark, sf_dir), "part_id")


@register("issue_counts", with_views(["devices"], _ISSUES + " UNION ALL ".join(
    f"SELECT '{t}' AS issue_type, CAST(count(*) FILTER (WHERE issue_type = '{t}') AS BIGINT) AS device_count FROM iss"
    for t in K.ISSUE_TYPES)))
def issue_counts(spark, sf_dir):
    return V.issue_counts(V.device_issues(_devices(spark, sf_dir), "part_id"))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PROMPTS = f"""
, batched AS (SELECT issue_type, device_name, (row_number() OVER (PARTITION BY issue_type ORDER BY part_id, device_name) - 1) // {BATCH} AS batch FROM iss)
, prm AS (SELECT issue_type, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INT) AS device_count,
       CASE issue_type WHEN 'not_seen_recently' THEN 'Check these: ' ELSE 'Suggest next steps for these devices (' || issue_type || '): ' END
       || '[' || chr(39) || string_agg(device_name, chr(39) || ', ' || chr(39) ORDER BY device_name) || chr(39) || '].' AS prompt
FROM batched GROUP BY issue_type, batch)
"""


def _prompts(spark, sf_dir):
    wording = spark.createDataFrame([("not_seen_recently", "Check these: {devices}.")], "issue_type string, template string")
    return V.recommendation_prompts(V.device_issues(_devices(spark, sf_dir), "part_id"), "part_id", batch_size=BATCH, templates=wording)


@register("prompts", with_views(["devices"], _ISSUES + _PROMPTS + "SELECT * FROM prm"))
def prompts(spark, sf_dir):
    """V9: prompt table, one prompt per issue type and batch of devices, in a caller's wording."""
    return _prompts(spark, sf_dir)


@register("prompt_requests", with_views(["devices"], _ISSUES + _PROMPTS + """
SELECT issue_type, batch, to_json([{'role': 'user', 'content': prompt}]) :: VARCHAR AS messages FROM prm
"""))
def prompt_requests(spark, sf_dir):
    """N9 for a bare prompt: one user message for each V9 prompt."""
    from deskline.operators.documents import prompt_request
    p = _prompts(spark, sf_dir)
    return p.select("issue_type", "batch", prompt_request(p).alias("messages"))


@register("parse_flags", with_views(["device_flags_raw"], """
SELECT part_id, flag_txt, reboot_txt, coalesce(lower(flag_txt) IN ('yes', 'true'), false) AS flag,
       CASE lower(reboot_txt) WHEN 'true' THEN true WHEN 'false' THEN false END AS reboot
FROM device_flags_raw
"""))
def parse_flags(spark, sf_dir):
    """yes/no text flags and the tri-state reboot flag."""
    ensure_session(spark)
    return V.parse_flags(view(spark, sf_dir, "device_flags_raw"))


_INTEG_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS integration, count(*) FILTER (WHERE {n}) AS device_count FROM devices" for n in K.INTEGRATIONS)


@register("device_report", with_views(["devices"], _MATCH + _ISSUES + f"""
, tot AS (SELECT to_json({{'total_devices': count(*), 'inactive_devices': count(*) FILTER (WHERE Inactive_Computer),
                          'no_antivirus': CAST(0 AS BIGINT), 'no_last_reboot': CAST(0 AS BIGINT)}}) :: VARCHAR AS j FROM devices)
, man AS (SELECT to_json(map_from_entries(list({{'k': manufacturer_name, 'v': n}} ORDER BY manufacturer_name, n))) :: VARCHAR AS j
          FROM (SELECT manufacturer_name, count(*) AS n FROM devices
                WHERE manufacturer_name IS NOT NULL AND manufacturer_name <> '' AND manufacturer_name <> 'N/A'
                GROUP BY manufacturer_name))
, itg AS (SELECT to_json(map_from_entries(list({{'k': integration, 'v': device_count}} ORDER BY integration, device_count))) :: VARCHAR AS j
          FROM ({_INTEG_SQL}))
, sec AS (SELECT to_json(map_from_entries(list({{'k': match_class, 'v': n}} ORDER BY match_class, n))) :: VARCHAR AS j
          FROM (SELECT match_class, count(*) AS n FROM m WHERE match_class IS NOT NULL GROUP BY match_class))
, isu AS (SELECT to_json(map_from_entries(list({{'k': t, 'v': n}} ORDER BY t, n))) :: VARCHAR AS j
          FROM (SELECT t, (SELECT count(*) FROM iss WHERE issue_type = t) AS n FROM (VALUES {", ".join(f"('{t}')" for t in K.ISSUE_TYPES)}) AS v(t)))
SELECT '{{"counts":' || tot.j || ',"manufacturers":' || man.j || ',"integrations":' || itg.j
       || ',"integration_matches":' || sec.j || ',"issues":' || isu.j || '}}' AS payload
FROM tot, man, itg, sec, isu
"""))
def device_report(spark, sf_dir):
    """The one-row analytics payload (JSON text)."""
    return V.report_payload(_devices(spark, sf_dir), "part_id")
