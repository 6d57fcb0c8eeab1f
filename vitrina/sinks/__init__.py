"""Sinks: CSV / JSON exports and snapshot writes."""

from .files import csv_lines, json_lines, write_csv, write_json, write_snapshot

__all__ = ["csv_lines", "json_lines", "write_csv", "write_json", "write_snapshot"]
