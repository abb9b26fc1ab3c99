from deskline.functions.labels import (
    json_valid, key_str, list_desc, lookup, priority_color, priority_label, status_label, strip_json_ws, strip_ws, tri_state,
    truncate_desc, ticket_url, yes_no,
)
from deskline.functions.stamps import (
    day_diff, display_text, display_time, hours_between, hours_text, ltz, minute_diff, parse_iso, parse_strict_z,
    seconds_between, week_end, week_start,
)

__all__ = [
    "day_diff", "display_text", "display_time", "hours_between", "hours_text", "json_valid", "key_str", "list_desc", "lookup", "ltz",
    "minute_diff", "parse_iso", "parse_strict_z", "priority_color", "priority_label", "seconds_between",
    "status_label", "strip_json_ws", "strip_ws", "ticket_url", "tri_state", "truncate_desc", "week_end", "week_start",
    "yes_no",
]
