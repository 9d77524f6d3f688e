"""Events in canonical form, from JSON lines, columnar profiles or relational tables; and sinks."""

from .flat import CounterError, rechunked
from .jsonl import parse_events, read_jsonl, read_numbered
from .lines import numbered_lines
from .profiles import ingest
from .tables import events_from_tables
from .toy import toy_events
from .validate import check_events, refusing, validated

__all__ = ["CounterError", "check_events", "events_from_tables", "ingest", "numbered_lines", "parse_events", "read_jsonl", "read_numbered", "rechunked", "refusing", "toy_events", "validated"]
