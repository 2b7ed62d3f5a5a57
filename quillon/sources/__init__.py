"""Readers and writers."""

from .arrow_ipc import ArrowFileSource, arrow_to_table, read_arrow, table_to_arrow, write_arrow
from .csv import CsvResult, read_csv, spans_lines, write_csv_sample

__all__ = ["ArrowFileSource", "CsvResult", "arrow_to_table", "read_arrow", "read_csv", "spans_lines", "table_to_arrow", "write_arrow", "write_csv_sample"]
