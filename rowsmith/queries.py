"""The queries of the library's own operators and their DuckDB equivalents."""

from .jobs import block_jobs, check_jobs, edit_jobs, line_jobs, registry_jobs, table_jobs, text_jobs

QUERIES = {**line_jobs.QUERIES, **text_jobs.QUERIES, **block_jobs.QUERIES, **edit_jobs.QUERIES, **table_jobs.QUERIES, **check_jobs.QUERIES, **registry_jobs.QUERIES}
ORACLES = {**line_jobs.ORACLES, **text_jobs.ORACLES, **block_jobs.ORACLES, **edit_jobs.ORACLES, **table_jobs.ORACLES, **check_jobs.ORACLES, **registry_jobs.ORACLES}
