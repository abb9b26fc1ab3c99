"""Label, lookup and text expressions.

Lookups are CASE chains built from the dictionaries in ``deskline.constants`` (passed in as
parameters), so they compile into whole-stage codegen and never raise on a missing key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskline.constants import PRIORITY_LABELS, SHORT_DESCRIPTION_LIMIT, STATUS_LABELS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sql_lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v!r}D"  # a bare 0.5 would be a DECIMAL literal
    return repr(v)


def lookup(c, mapping: Mapping, default) -> Column:
    """``mapping.get(c, default)`` as one CASE expression; ``default`` may be a Column.

    With a column name and a literal default the CASE is built as SQL text (one JVM call instead
    of one per entry).
    """
    if isinstance(c, str) and not isinstance(default, Column) and mapping:
        whens = " ".join(f"WHEN {_sql_lit(k)} THEN {_sql_lit(v)}" for k, v in mapping.items())
        return F.expr(f"CASE `{c}` {whens} ELSE {_sql_lit(default)} END")
    col = _c(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(col == F.lit(k), F.lit(v)) if out is None
               else out.when(col == F.lit(k), F.lit(v)))
    dflt = default if isinstance(default, Column) else F.lit(default)
    return dflt if out is None else out.otherwise(dflt)


def priority_label(c, labels: Mapping = PRIORITY_LABELS) -> Column:
    """Priority -> label, default 'Unknown'."""
    return lookup(c, {k: v[0] for k, v in labels.items()}, "Unknown")


def priority_color(c, labels: Mapping = PRIORITY_LABELS) -> Column:
    """Priority -> colour, default 'default'."""
    return lookup(c, {k: v[1] for k, v in labels.items()}, "default")


def status_label(c, labels: Mapping = STATUS_LABELS) -> Column:
    """Status -> label, default 'Status ID <n>'."""
    return lookup(c, labels, F.concat(F.lit("Status ID "), _c(c).cast("string")))


def truncate_desc(c, limit: int = SHORT_DESCRIPTION_LIMIT) -> Column:
    """Longer than ``limit`` -> first ``limit`` characters + '...'; null -> ''."""
    d = F.coalesce(_c(c), F.lit(""))
    return F.when(F.length(d) > limit, F.concat(F.substring(d, 1, limit), F.lit("..."))).otherwise(d)


def list_desc(c, limit: int = SHORT_DESCRIPTION_LIMIT, missing: str = "No description available.") -> Column:
    """First ``limit`` characters + '...' always; default text when missing."""
    return F.concat(F.substring(F.coalesce(_c(c), F.lit(missing)), 1, limit), F.lit("..."))


def ticket_url(id_col, template: str) -> Column:
    """Deep link; every ``{id}`` in ``template`` is replaced by the ticket id."""
    parts = template.split("{id}")
    pieces: list[Column] = [F.lit(parts[0])]
    for p in parts[1:]:
        pieces += [_c(id_col).cast("string"), F.lit(p)]
    return F.concat(*pieces)


def yes_no(c) -> Column:
    """Text flag -> bool: 'yes' (any case) or JSON true -> true; null stays null."""
    return F.lower(_c(c)).isin("yes", "true")


def tri_state(c) -> Column:
    """Only a real boolean survives; anything else -> null."""
    t = F.lower(_c(c))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False))


def key_str(c) -> Column:
    """Key normalised to string; null stays null."""
    return _c(c).cast("string")


WS = " \t\n\r\x0b\x0c"


def strip_ws(c) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.btrim(_c(c), F.lit(WS))


def strip_json_ws(c) -> Column:
    """Without the white space JSON allows around a value."""
    return F.btrim(_c(c), F.lit(" \t\r\n"))


def json_valid(c) -> Column:
    """True when the whole text is one JSON value (nothing cut off, nothing after it).

    The text is put once into a list and once into an object: only a single whole value leaves the
    list with one item and the object with one key.
    """
    t = _c(c)
    one_item = F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1
    one_key = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), t, F.lit("}")))) == 1
    return F.coalesce(one_item & one_key, F.lit(False))
