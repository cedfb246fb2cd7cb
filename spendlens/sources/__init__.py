"""Readers, writers and table helpers."""
from .readers import (
    head_rows,
    read_cycles,
    read_delimited,
    read_mart_export,
    row_range,
    schema_table,
)
from .sinks import append_to, materialize, typed_empty, write_csv, write_lines

__all__ = [
    "append_to", "head_rows", "materialize", "read_cycles", "read_delimited",
    "read_mart_export", "row_range", "schema_table", "typed_empty", "write_csv",
    "write_lines",
]
