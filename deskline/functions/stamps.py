"""Stamp expressions.

All functions take and return ``Column``s and stay inside whole-stage codegen. Inputs may be
``timestamp_ntz`` (driver Parquet) or ``timestamp``; with the session zone pinned to UTC the two
carry the same wall-clock, and :func:`ltz` converts where an instant is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskline.constants import DISPLAY_ZONE

# B1 guard: date, optional time, optional fraction, optional offset ("Z" is stripped first).
ISO_GUARD = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:\d{2})?)?$"
# B2 guard: only ...T...:ss.fZ or ...T...:ssZ.
# (T and Z in either case, as strptime matches literals case-insensitively)
STRICT_Z = r"^(\d{4})-(\d{1,2})-(\d{1,2})[Tt](\d{1,2}):(\d{1,2}):(\d{1,2})(\.\d{1,6})?[Zz]$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ltz(c) -> Column:
    """Zone-less stamp -> instant (UTC session), so epoch arithmetic applies."""
    return _c(c).cast("timestamp")


def parse_iso(c) -> Column:
    """ISO text -> timestamp; trailing Z stripped, bad or empty -> null.

    The regex guard matters: Spark's cast alone accepts forms such as '2024' or '2024-1-5'.
    A stamp with an offset is converted to UTC; a plain one is read as UTC.
    """
    t = F.regexp_replace(_c(c), "Z+$", "")
    # Spark's cast rejects minutes precision followed by an offset (HH:MM+hh:mm): add the seconds.
    t = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})([+-]\d{2}:\d{2})$", "$1:00$2")
    return F.when(t.rlike(ISO_GUARD), t.try_cast("timestamp"))


def parse_strict_z(c) -> Column:
    """B2: only ``YYYY-M-DTH:M:S[.ffffff]Z`` parses (1-2 digit fields allowed); else null."""
    s = _c(c)
    g = [F.regexp_extract(s, STRICT_Z, i) for i in range(1, 8)]
    frac = F.when(g[6] == "", F.lit("0")).otherwise(F.concat(F.lit("0"), g[6]))
    secs = (g[5].cast("int") + frac.cast("decimal(8,6)")).cast("decimal(16,6)")
    made = F.try_make_timestamp(g[0].cast("int"), g[1].cast("int"), g[2].cast("int"),
                                g[3].cast("int"), g[4].cast("int"), secs)
    # make_timestamp would roll second 60 into the next minute; the strict form rejects it
    return F.when(s.rlike(STRICT_Z) & (g[5].cast("int") < 60), made)


def hours_between(a, b) -> Column:
    """Elapsed hours from a to b, fractions kept."""
    return (F.unix_micros(ltz(b)) - F.unix_micros(ltz(a))) / F.lit(3.6e9)


def seconds_between(a, b) -> Column:
    """Elapsed seconds from a to b as double."""
    return (F.unix_micros(ltz(b)) - F.unix_micros(ltz(a))) / F.lit(1e6)


def minute_diff(a, b) -> Column:
    """Minute boundaries crossed from a to b (T-SQL DATEDIFF(MINUTE, a, b))."""
    return (F.floor(F.unix_micros(ltz(b)) / F.lit(60_000_000))
            - F.floor(F.unix_micros(ltz(a)) / F.lit(60_000_000)))


def day_diff(a, b) -> Column:
    """Date boundaries crossed from a to b (T-SQL DATEDIFF(DAY, a, b))."""
    return F.datediff(_c(b).cast("date"), _c(a).cast("date"))


def week_start(as_of) -> Column:
    """The week's Sunday: as_of - (weekday + 1) days, weekday 0 = Monday.

    On a Sunday this is the *previous* Sunday (kept on purpose).
    """
    d = _c(as_of).cast("date")
    return F.date_sub(d, F.weekday(d) + 1)


def week_end(as_of) -> Column:
    return F.date_add(week_start(as_of), 6)


def display_time(c, zone: str = DISPLAY_ZONE, std_label: str = "CST", dst_label: str = "CDT",
                 std_offset_hours: int = -6) -> Column:
    """``MM-dd-yy h:mm AM CDT`` in ``zone``; null -> 'N/A'.

    The zone label comes from the actual offset, not from ``z`` (that would follow the session zone).
    """
    t = ltz(c)
    local = F.from_utc_timestamp(t, zone)
    offset_h = (F.unix_micros(local) - F.unix_micros(t)) / F.lit(3.6e9)
    label = F.when(offset_h == F.lit(std_offset_hours), F.lit(std_label)).otherwise(F.lit(dst_label))
    return F.when(t.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.date_format(local, "MM-dd-yy h:mm a"), F.lit(" "), label))


def display_text(c, **zone) -> Column:
    """B12 on a stamp's text: null and empty -> 'N/A', not a stamp -> 'Invalid Date', else its display."""
    t = _c(c)
    stamp = parse_iso(t)
    return (F.when(F.coalesce(t, F.lit("")) == "", F.lit("N/A")).when(stamp.isNull(), F.lit("Invalid Date"))
            .otherwise(display_time(stamp, **zone)))


def hours_text(seconds) -> Column:
    """Hours with two decimals, half-up: hundredths = floor((|s|*100 + 1800) / 3600)."""
    h100 = F.floor((F.abs(_c(seconds)) * 100 + 1800) / 3600).cast("bigint")
    return F.concat((h100 / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((h100 % 100).cast("string"), 2, "0"))
