"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans import archive, desk, records, scans

QUERIES = archive.QUERIES | desk.QUERIES | scans.QUERIES | records.QUERIES
SQL = archive.SQL | desk.SQL | scans.SQL | records.SQL
