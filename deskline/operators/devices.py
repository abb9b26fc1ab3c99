"""Device report operators.

Per-device work is row-local (no shuffle); counts are partial aggregates. Membership lists
(which device is in which class / issue) stay long-form tables -- nothing collects an unbounded
list of devices into one row except the prompt batches, which are bounded by ``batch_size``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.constants import FULL_MATCH_SETS, INTEGRATIONS, ISSUE_TYPES, UNNAMED_DEVICE
from deskline.functions import tri_state, yes_no
from deskline.operators.ranking import dense_number
from deskline.sources.schemas import DEVICE_FLAGS, DEVICE_IDS, DEVICE_STRINGS

DEVICE_KEY = "serial_number"  # what tells the devices of a feed apart


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


# --- B3-B5, I2 ----------------------------------------------------------------------------------
def coerce_devices(raw: DataFrame) -> DataFrame:
    """Text-typed device feed -> typed devices with the model's defaults.

    Flags: 'yes' (any case) or true -> true, anything else false, missing -> false (B3, B5).
    rebootRequired: only a real boolean survives (B4). Strings default to 'N/A'; ids stay text,
    ``cybercns_id`` defaults to 'N/A', the others to null.
    """
    cols = [F.coalesce(F.col(c), F.lit("N/A")).alias(c) if c in raw.columns else F.lit("N/A").alias(c)
            for c in DEVICE_STRINGS]
    cols.append((tri_state("rebootRequired") if "rebootRequired" in raw.columns
                 else F.lit(None).cast("boolean")).alias("rebootRequired"))
    for c in DEVICE_IDS:
        v = F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
        cols.append((F.coalesce(v, F.lit("N/A")) if c == "cybercns_id" else v).alias(c))
    for c in DEVICE_FLAGS:
        cols.append((F.coalesce(yes_no(c), F.lit(False)) if c in raw.columns else F.lit(False)).alias(c))
    keep = [c for c in raw.columns if c not in set(DEVICE_STRINGS + DEVICE_IDS + DEVICE_FLAGS + ["rebootRequired"])]
    return raw.select(*keep, *cols)


def parse_flags(df: DataFrame, flag: str = "flag_txt", reboot: str = "reboot_txt") -> DataFrame:
    """B3 + B5 on a yes/no text flag, B4 on a reboot text."""
    return df.select("*", F.coalesce(yes_no(flag), F.lit(False)).alias("flag"), tri_state(reboot).alias("reboot"))


# --- V1 -----------------------------------------------------------------------------------------
def device_summary(df: DataFrame, key: str | None = None) -> DataFrame:
    """V1: the 30-column summary with the report's names.

    ``locationName`` and ``model_name`` are not device fields, so they are the literal 'N/A' (D23).
    """
    cols = [] if key is None else [F.col(key)]
    cols += [
        F.col("Name").alias("device_name"), "Datto_RMM", "Huntress", F.col("ITGlue").alias("IT_Glue"), "Workstation_AD",
        "Server_AD", "ImmyBot", "Auvik", "CyberCNS", "Inactive_Computer",
        F.col("LastLoggedOnUser").alias("LastLoggedInUser"), "IPv4Address", "OperatingSystem", "antivirusProduct",
        "antivirusStatus", "lastReboot", "lastSeen", "patchStatus", "rebootRequired", "warrantyDate", "datto_id",
        "huntress_id", "immy_id", "auvik_id", "cybercns_id", F.lit("N/A").alias("locationName"), "itglue_id",
        "manufacturer_name", F.lit("N/A").alias("model_name"), "serial_number",
    ]
    return df.select(*cols)


# --- V2-V4 --------------------------------------------------------------------------------------
def device_totals(df: DataFrame) -> DataFrame:
    """V2: totals; counters the report declares but never fills stay 0."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total_devices"),
                  F.count_if(_flag("Inactive_Computer")).cast("bigint").alias("inactive_devices"),
                  F.lit(0).cast("bigint").alias("no_antivirus"),
                  F.lit(0).cast("bigint").alias("no_last_reboot"))


def manufacturer_counts(df: DataFrame) -> DataFrame:
    """V3: devices per manufacturer; null, '' and 'N/A' are skipped."""
    m = F.col("manufacturer_name")
    return (df.filter(m.isNotNull() & (m != "") & (m != "N/A"))
            .groupBy(m.alias("manufacturer_name")).agg(F.count(F.lit(1)).cast("bigint").alias("device_count")))


def integration_counts(df: DataFrame, integrations: Sequence[str] = INTEGRATIONS) -> DataFrame:
    """V4: devices per integration, all integrations listed (zero kept)."""
    sums = df.agg(*[F.count_if(_flag(n)).cast("bigint").alias(n) for n in integrations])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("integration"), F.lit(i).alias("pos"), F.col(n).alias("device_count"))
        for i, n in enumerate(integrations)])).alias("x")).select(
        "x.integration", F.col("x.pos").cast("int").alias("pos"), "x.device_count")


# --- V5, V6 -------------------------------------------------------------------------------------
def matched_integrations(integrations: Sequence[str] = INTEGRATIONS) -> Column:
    """V5: names of the integrations set on a device, in the fixed order."""
    return F.filter(F.array(*[F.when(_flag(n), F.lit(n)) for n in integrations]), lambda x: x.isNotNull())


def device_name(c: str = "device_name") -> Column:
    """Name rule: missing or empty -> 'Unnamed Device'."""
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(UNNAMED_DEVICE)).otherwise(F.col(c))


def match_class(lst: Column, full_sets: Sequence[Sequence[str]] = FULL_MATCH_SETS) -> Column:
    """V6: 'full' when the set equals one full set exactly (so Auvik on -> not full), else 'single'
    for one integration, 'partial' for more; none -> null."""
    srt = F.array_sort(lst)
    full = None
    for s in full_sets:
        c = srt == F.array(*[F.lit(x) for x in sorted(s)])
        full = c if full is None else full | c
    return (F.when(full, F.lit("full")).when(F.size(lst) == 1, F.lit("single"))
            .when(F.size(lst) > 1, F.lit("partial")))


def device_match(df: DataFrame, key: str = DEVICE_KEY, integrations: Sequence[str] = INTEGRATIONS,
                 full_sets: Sequence[Sequence[str]] = FULL_MATCH_SETS) -> DataFrame:
    """V5 + V6 per device."""
    lst = matched_integrations(integrations)
    return df.select(
        key, device_name().alias("device_name"),
        F.array_join(lst, ", ").alias("matched_integrations"),
        F.size(lst).cast("int").alias("n_integrations"),
        match_class(lst, full_sets).alias("match_class"))


def match_summary(matches: DataFrame) -> DataFrame:
    """V7: size of each report section (full / partial / single); the members are ``device_match``."""
    return (matches.filter(F.col("match_class").isNotNull()).groupBy("match_class")
            .agg(F.count(F.lit(1)).cast("bigint").alias("device_count")))


# --- V8, V9 -------------------------------------------------------------------------------------
def device_issues(df: DataFrame, key: str = DEVICE_KEY) -> DataFrame:
    """V8 long-form: (issue_type, device). Only inactivity is detected; the other issue lists are
    declared but have no rule, so they stay empty (D22)."""
    return (df.filter(_flag("Inactive_Computer"))
            .select(F.lit("not_seen_recently").alias("issue_type"), key, device_name().alias("device_name")))


def issue_counts(issues: DataFrame, issue_types: Sequence[str] = ISSUE_TYPES) -> DataFrame:
    """V8 sizes for every declared issue type (zero kept)."""
    counts = issues.agg(*[F.count_if(F.col("issue_type") == t).cast("bigint").alias(t) for t in issue_types])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("issue_type"), F.col(t).alias("device_count")) for t in issue_types])).alias("x")) \
        .select("x.*")


DEFAULT_PROMPT = "Suggest next steps for these devices ({issue}): {devices}."


def recommendation_prompts(issues: DataFrame, key: str = DEVICE_KEY, batch_size: int = 500,
                           templates: DataFrame | None = None, default: str = DEFAULT_PROMPT) -> DataFrame:
    """V9: one prompt per issue type and batch of at most ``batch_size`` devices (batch 0 alone while an
    issue has no more). Devices are numbered densely inside their issue type, so sparse keys do not
    split batches and repeated keys do not fill one; the long table of devices is ``device_issues``.

    ``templates`` is the caller's wording (``issue_type``, ``template``), where ``{devices}`` becomes
    the sorted names like ``['DEV-1', 'DEV-2']`` and ``{issue}`` the issue type; issue types without one
    get ``default``. Devices are numbered in the order of ``key`` whatever the size of the fleet.
    """
    numbered = dense_number(issues, ["issue_type"], [key, "device_name"], "_n")
    g = (numbered.groupBy("issue_type", F.floor(F.col("_n") / batch_size).alias("batch"))
         .agg(F.array_sort(F.collect_list("device_name")).alias("names")))
    if templates is not None:
        g = g.join(templates.select("issue_type", "template"), "issue_type", "left")
    else:
        g = g.withColumn("template", F.lit(None).cast("string"))
    listed = F.concat(F.lit("['"), F.array_join("names", "', '"), F.lit("']"))
    text = F.replace(F.coalesce("template", F.lit(default)), F.lit("{issue}"), F.col("issue_type"))
    return g.select("issue_type", "batch", F.size("names").cast("int").alias("device_count"),
                    F.replace(text, F.lit("{devices}"), listed).alias("prompt"))


# --- I13 ----------------------------------------------------------------------------------------
def report_payload(devices: DataFrame, key: str = DEVICE_KEY) -> DataFrame:
    """One-row analytics payload as JSON: totals, manufacturers, integrations, section and issue sizes.

    Built from aggregates only (one row per manufacturer / integration / class), never from the
    device rows themselves.
    """
    totals = device_totals(devices)
    manu = manufacturer_counts(devices).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("manufacturer_name", "device_count")))).alias("m"))
    integ = integration_counts(devices).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("integration", "device_count")))).alias("i"))
    sections = match_summary(device_match(devices, key)).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("match_class", "device_count")))).alias("s"))
    issues = issue_counts(device_issues(devices, key)).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue_type", "device_count")))).alias("u"))
    one = (totals.select(F.lit(0).alias("_p"), F.to_json(F.struct("*")).alias("counts"))
           .unionByName(manu.select(F.lit(1).alias("_p"), F.to_json("m").alias("counts")))
           .unionByName(integ.select(F.lit(2).alias("_p"), F.to_json("i").alias("counts")))
           .unionByName(sections.select(F.lit(3).alias("_p"), F.to_json("s").alias("counts")))
           .unionByName(issues.select(F.lit(4).alias("_p"), F.to_json("u").alias("counts"))))
    names = F.array(*[F.lit(p) for p in ["counts", "manufacturers", "integrations", "integration_matches", "issues"]])
    return one.agg(F.array_sort(F.collect_list(F.struct("_p", "counts"))).alias("a")).select(
        F.concat(F.lit("{"), F.array_join(F.transform(
            "a", lambda x: F.concat(F.lit('"'), F.element_at(names, x["_p"] + 1), F.lit('":'), x["counts"])), ","),
            F.lit("}")).alias("payload"))
