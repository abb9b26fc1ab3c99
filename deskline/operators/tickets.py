"""Ticket operators.

Every operator is DataFrame -> DataFrame from built-in expressions; ``as_of`` is always a
parameter (never ``current_timestamp()``), so reruns give the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskline.constants import (
    AGE_POINTS_PER_DAY, CLOSED_STATUS, EXCLUDED_QUEUES, PRIORITY_DEFAULT_WEIGHT, PRIORITY_WEIGHTS,
    SLA_MISS_PENALTY, SLA_PAIRS, STATUS_DEFAULT_WEIGHT, STATUS_WEIGHTS,
)
from deskline.functions import (
    display_time, hours_between, hours_text, list_desc, lookup, ltz, parse_iso, priority_color, priority_label,
    seconds_between, status_label, ticket_url, truncate_desc,
)

DEFAULT_URL = "https://tickets.example/detail?ticketId={id}"


def as_of_col(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def _stamp(df: DataFrame, c: str) -> tuple[Column, Column]:
    """(instant, is_bad) for a stamp column. Text stamps are parsed with T9 (offset kept, 'Z' =
    UTC); a non-empty text that does not parse is *bad*, which differs from missing."""
    if dict(df.dtypes).get(c) == "string":
        parsed = parse_iso(c)
        return parsed, F.coalesce(F.col(c) != "", F.lit(False)) & parsed.isNull()
    return ltz(c), F.lit(False)


# --- T10 ----------------------------------------------------------------------------------------
def exclude_queues(df: DataFrame, ids: Sequence[int] = EXCLUDED_QUEUES, col: str = "queueID") -> DataFrame:
    """Drop tickets in excluded queues; a null queue is kept (plain NOT IN would lose it)."""
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(list(ids)))


# --- T5 -----------------------------------------------------------------------------------------
def sla_results(df: DataFrame, as_of, pairs=SLA_PAIRS, out: str = "sla_results") -> DataFrame:
    """T5: one struct per SLA pair, in pair order.

    met = met <= due; seconds = due - met, or due - as_of while open; no due date, or a bad stamp
    on either side -> not met, null seconds, 'N/A' and 'Not completed'.
    """
    now = as_of_col(as_of)
    items = []
    for met_c, due_c, name in pairs:
        (met, met_bad), (due, due_bad) = _stamp(df, met_c), _stamp(df, due_c)
        ok = ~(met_bad | due_bad)
        met, due = F.when(ok, met), F.when(ok, due)
        has_due = due.isNotNull()
        items.append(F.struct(
            F.lit(name).alias("sla_name"),
            F.when(has_due & met.isNotNull(), met <= due).otherwise(F.lit(False)).alias("sla_met"),
            F.when(has_due, seconds_between(F.coalesce(met, now), due)).alias("time_left_seconds"),
            display_time(due).alias("due_date_formatted"),
            F.when(has_due & met.isNotNull(), display_time(met)).otherwise(F.lit("Not completed"))
             .alias("met_date_formatted"),
            due.alias("due_at"),
            F.when(has_due, met).alias("met_at"),
        ))
    return df.withColumn(out, F.array(*items))


# --- T6 -----------------------------------------------------------------------------------------
def ticket_weight(df: DataFrame, as_of, priority_weights=PRIORITY_WEIGHTS, status_weights=STATUS_WEIGHTS,
                  miss_penalty: int = SLA_MISS_PENALTY, day_points: int = AGE_POINTS_PER_DAY,
                  pairs=SLA_PAIRS) -> DataFrame:
    """Priority points + status points + penalty per SLA not met + points per whole day of age.

    Adds ``sla_missed`` and ``weight`` (a pair counts as met exactly when T5 says so). A null create date adds no age points;
    whole days are floored, so tickets created after ``as_of`` lose points, as in the source rule.
    """
    now = as_of_col(as_of)
    # Only the met flags matter for the score: count misses from the stamps directly, without
    # building the display strings of the SLA structs.
    missed = None
    for met_c, due_c, _ in pairs:
        (met, _), (due, _) = _stamp(df, met_c), _stamp(df, due_c)  # a bad stamp parses to null: a miss
        miss = F.when(due.isNotNull() & met.isNotNull() & (met <= due), 0).otherwise(1)
        missed = miss if missed is None else missed + miss
    created, _ = _stamp(df, "createDate")
    age_days = F.floor((F.unix_micros(now) - F.unix_micros(created)) / F.lit(86_400_000_000))
    weight = (lookup("priority", priority_weights, PRIORITY_DEFAULT_WEIGHT)
              + lookup("status", status_weights, STATUS_DEFAULT_WEIGHT)
              + missed * miss_penalty
              + F.coalesce(age_days * day_points, F.lit(0)))
    return (df.withColumn("sla_missed", missed.cast("bigint"))
            .withColumn("weight", weight.cast("bigint")))


# --- T7 -----------------------------------------------------------------------------------------
def next_ticket(df: DataFrame, per: Sequence[str] | None = None, n: int = 1, seq: str = "id",
                weight: str = "weight", rank_col: str | None = None) -> DataFrame:
    """Highest weight first, ties keep input order (lowest ``seq``).

    * ``per`` is None: global top-n -> ``TakeOrderedAndProject``.
    * per group, n == 1: ``max_by`` aggregate; partial aggregation runs before the shuffle, so a
      group holding a third of all rows costs one row per map task, not a sort of that group.
    * per group, n > 1: ``row_number() <= n``; Spark inserts a partial ``WindowGroupLimit`` before the
      shuffle, so each map task sends at most n rows per group; ``rank_col`` keeps the rank.
    """
    if not per:
        return df.orderBy(F.col(weight).desc(), F.col(seq).asc()).limit(n)
    per = list(per)
    if n == 1:
        payload = [c for c in df.columns if c not in per]
        best = F.max_by(F.struct(*[F.col(c) for c in payload]),
                        F.struct(F.col(weight), -F.col(seq)))
        return df.groupBy(*per).agg(best.alias("_best")).select(*per, "_best.*")
    w = Window.partitionBy(*per).orderBy(F.col(weight).desc(), F.col(seq).asc())
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return ranked.withColumnRenamed("_rn", rank_col) if rank_col else ranked.drop("_rn")


# --- T14 ----------------------------------------------------------------------------------------
def ticket_digest(df: DataFrame) -> Column:
    """JSON digest of the chosen ticket(s): ``{"tickets":[{ticket_id,title,points}]}``."""
    one = F.struct(F.col("id").alias("ticket_id"), F.col("title"), F.col("weight").alias("points"))
    return F.to_json(F.struct(F.array(one).alias("tickets")))


# --- T1-T4, T11 ---------------------------------------------------------------------------------
TICKET_DIMS = ["companyID", "contactID", "issueType", "subIssueType"]


def ticket_counts(df: DataFrame, dims: Sequence[str] = TICKET_DIMS) -> DataFrame:
    """Ticket counts per value of each dimension, plus the total, in one pass.

    GROUPING SETS ((d1), (d2), ..., ()) -> (dim, value, ticket_count). A null value is its own
    group; ``grouping_id`` keeps it apart from the roll-up row.
    """
    dims = list(dims)
    sets = [[F.col(d)] for d in dims] + [[]]
    agg = df.groupingSets(sets, *dims).agg(F.count(F.lit(1)).alias("ticket_count"),
                                           F.grouping_id(*dims).alias("_gid"))
    full = (1 << len(dims)) - 1
    dim = F.lit("total")
    value = F.lit(None).cast("bigint")
    for i, d in enumerate(dims):
        gid = full ^ (1 << (len(dims) - 1 - i))
        dim = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim)
        value = F.when(F.col("_gid") == gid, F.col(d).cast("bigint")).otherwise(value)
    return agg.select(dim.alias("dim"), value.alias("value"), F.col("ticket_count").cast("bigint"))


def priority_histogram(df: DataFrame, priorities: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Counts for each listed priority, zero-filled; other priorities ignored."""
    counts = df.agg(*[F.count_if(F.col("priority") == p).alias(f"p{p}") for p in priorities])
    stacked = ", ".join(f"{p}, p{p}" for p in priorities)
    return counts.selectExpr(f"stack({len(priorities)}, {stacked}) AS (priority, ticket_count)") \
                 .select(F.col("priority").cast("int"), F.col("ticket_count").cast("bigint"))


def ticket_summary(df: DataFrame, closed_status: int = CLOSED_STATUS) -> DataFrame:
    """T1 total + T2 SLA-met (IS TRUE only) + T4 average resolution hours + T11 open count."""
    res_h = hours_between("createDate", "resolvedDateTime")
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_tickets"),
        F.count_if(F.col("serviceLevelAgreementHasBeenMet") == F.lit(True)).cast("bigint").alias("sla_met_count"),
        F.coalesce(F.avg(res_h), F.lit(0.0)).alias("average_resolution_time"),
        F.count_if(F.col("status").isNotNull() & (F.col("status") != closed_status)).cast("bigint")
         .alias("open_tickets"),
    )


def open_tickets(df: DataFrame, closed_status: int = CLOSED_STATUS, per: Sequence[str] = ()) -> DataFrame:
    """Tickets whose status is set and not closed (optionally per group)."""
    cond = F.col("status").isNotNull() & (F.col("status") != closed_status)
    g = df.groupBy(*per) if per else df.groupBy()
    return g.agg(F.count_if(cond).cast("bigint").alias("open_tickets"))


# --- T12 ----------------------------------------------------------------------------------------
def my_tickets(df: DataFrame, url_template: str = DEFAULT_URL, user: str = "assignedResourceID") -> DataFrame:
    """The ticket list one user sees; defaults 'Untitled' and 'Unknown'."""
    return df.select(
        F.col(user),
        F.col("id"),
        F.coalesce(F.col("title"), F.lit("Untitled")).alias("title"),
        list_desc("description").alias("description"),
        F.coalesce(F.col("status").cast("string"), F.lit("Unknown")).alias("status"),
        ticket_url("id", url_template).alias("url"),
    )


# --- T8 -----------------------------------------------------------------------------------------
def sla_timeline(df: DataFrame, as_of, keep=("id",)) -> DataFrame:
    """One row per SLA entry with status text, colour and time text.

    'Met' / 'Not Met'; 'Not Yet Due' when still open and due after ``as_of`` (compared on real
    stamps). Time text uses half-up hundredths of an hour. A ticket without SLA entries gets one
    placeholder row.
    """
    now = as_of_col(as_of)
    x = df.select(*keep, F.posexplode_outer("sla_results").alias("pos", "s"))
    s = F.col("s")
    open_not_due = (s["met_at"].isNull() & s["due_at"].isNotNull() & (s["due_at"] > now))
    status_text = (F.when(s.isNull(), F.lit("No SLA Information Available"))
                   .when(open_not_due, F.lit("Not Yet Due"))
                   .when(s["sla_met"], F.lit("Met")).otherwise(F.lit("Not Met")))
    color = (F.when(s.isNull(), F.lit("attention")).when(open_not_due, F.lit("default"))
             .when(s["sla_met"], F.lit("good")).otherwise(F.lit("attention")))
    secs = s["time_left_seconds"]
    time_status = (F.when(secs.isNull(), F.lit("N/A"))
                   .when(secs >= 0, F.concat(F.lit("Time Left: "), hours_text(secs), F.lit(" hours")))
                   .otherwise(F.concat(F.lit("Overdue by: "), hours_text(secs), F.lit(" hours"))))
    return x.select(
        *keep,
        F.coalesce(F.col("pos"), F.lit(0)).cast("int").alias("pos"),
        s["sla_name"].alias("sla_name"),
        status_text.alias("status_text"),
        color.alias("status_color"),
        s["due_date_formatted"].alias("due_date"),
        s["met_date_formatted"].alias("met_date"),
        time_status.alias("time_status"),
    )


# --- T13 ----------------------------------------------------------------------------------------
def ticket_detail(df: DataFrame, as_of, url_template: str = DEFAULT_URL, keep: Sequence = ()) -> DataFrame:
    """The detail record: labels, short description, SLA timeline text, link.

    The timeline is rendered inside the row (no explode + regroup): one line per SLA entry,
    ``name: status | due | met | time``, joined with '; '. ``keep`` columns (names or Columns) are
    carried along.
    """
    now = as_of_col(as_of)
    with_sla = df if "sla_results" in df.columns else sla_results(df, now)

    def line(s):
        open_not_due = s["met_at"].isNull() & s["due_at"].isNotNull() & (s["due_at"] > now)
        st = (F.when(open_not_due, F.lit("Not Yet Due")).when(s["sla_met"], F.lit("Met"))
              .otherwise(F.lit("Not Met")))
        secs = s["time_left_seconds"]
        ts = (F.when(secs.isNull(), F.lit("N/A"))
              .when(secs >= 0, F.concat(F.lit("Time Left: "), hours_text(secs), F.lit(" hours")))
              .otherwise(F.concat(F.lit("Overdue by: "), hours_text(secs), F.lit(" hours"))))
        return F.concat_ws(" | ", F.concat(s["sla_name"], F.lit(": "), st), s["due_date_formatted"],
                           s["met_date_formatted"], ts)

    return with_sla.select(
        F.col("id"),
        F.col("title"),
        truncate_desc("description").alias("description"),
        priority_label("priority").alias("priority_text"),
        priority_color("priority").alias("priority_color"),
        status_label("status").alias("status_text"),
        F.array_join(F.transform("sla_results", line), "; ").alias("timeline"),
        ticket_url("id", url_template).alias("url"),
        *keep,
    )
