"""SQL fragments for the DuckDB oracle texts (written directly in SQL, independent of the
DataFrame operators; only the fixed values are shared)."""

from __future__ import annotations

from deskline import constants as K
from deskline.sources.fixtures import AS_OF_DESK, AS_OF_EVENTS


def ts(lit: str) -> str:
    return f"TIMESTAMP '{lit}'"


DESK = ts(AS_OF_DESK)
EVENTS = ts(AS_OF_EVENTS)


def case_map(col: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v if not isinstance(v, str) else repr(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {default} END"


def in_list(vals) -> str:
    return ", ".join(str(v) for v in vals)


def sla_met(met: str, due: str) -> str:
    return f"({due} IS NOT NULL AND {met} IS NOT NULL AND {met} <= {due})"


def secs(a: str, b: str) -> str:
    """Seconds from a to b as double."""
    return f"(epoch_us({b}) - epoch_us({a})) / 1e6"


def display(col: str) -> str:
    """Chicago display time with the zone label from the offset; null -> 'N/A'."""
    local = f"timezone('America/Chicago', timezone('UTC', {col}))"
    off = f"(epoch_us({local}) - epoch_us({col})) / 3.6e9"
    return (f"CASE WHEN {col} IS NULL THEN 'N/A' ELSE strftime({local}, '%m-%d-%y %-I:%M %p') || ' ' || "
            f"CASE WHEN {off} = -6 THEN 'CST' ELSE 'CDT' END END")


def hours_text(sec: str) -> str:
    h100 = f"CAST(floor((abs({sec}) * 100 + 1800) / 3600) AS BIGINT)"
    return f"(CAST({h100} // 100 AS VARCHAR) || '.' || lpad(CAST({h100} % 100 AS VARCHAR), 2, '0'))"


def weight_expr(as_of: str = DESK) -> str:
    missed = " + ".join(f"CASE WHEN {sla_met(m, d)} THEN 0 ELSE 1 END" for m, d, _ in K.SLA_PAIRS)
    return (f"({case_map('priority', K.PRIORITY_WEIGHTS, '0')} + {case_map('status', K.STATUS_WEIGHTS, '10')}"
            f" + {K.SLA_MISS_PENALTY} * ({missed})"
            f" + coalesce(CAST(floor((epoch_us({as_of}) - epoch_us(createDate)) / 86400e6) AS BIGINT) * {K.AGE_POINTS_PER_DAY}, 0))")


def missed_expr() -> str:
    return "(" + " + ".join(f"CASE WHEN {sla_met(m, d)} THEN 0 ELSE 1 END" for m, d, _ in K.SLA_PAIRS) + ")"


EXCLUDE_QUEUES = f"(queueID IS NULL OR queueID NOT IN ({in_list(K.EXCLUDED_QUEUES)}))"
