from appconv.sources.logs import parse_quoted_lines, read_quoted_log
from appconv.sources.staging import cut_lineage, preview, stage
from appconv.sources.tables import (
    event_days,
    read_app_map,
    read_orc_events,
    read_request_csv,
    read_request_log,
    read_requests,
)

__all__ = [
    "cut_lineage",
    "event_days",
    "parse_quoted_lines",
    "preview",
    "read_app_map",
    "read_orc_events",
    "read_quoted_log",
    "read_request_csv",
    "read_request_log",
    "read_requests",
    "stage",
]
