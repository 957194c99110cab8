from .notes import csv_records, read_notes
from .schemas import SCHEMAS, schema_of
from .tables import (
    cached_features,
    materialize,
    read_cases,
    read_codes,
    read_optional,
    read_table,
    scan_for_keys,
    write_cases,
    write_report,
)

__all__ = [
    "SCHEMAS", "schema_of", "cached_features", "csv_records", "materialize", "read_cases", "read_codes",
    "read_notes", "read_optional", "read_table", "scan_for_keys", "write_cases", "write_report",
]
