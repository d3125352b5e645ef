"""The queries of the catalog engine and their SQL."""

from __future__ import annotations

from quaver import queries_catalog, queries_files, queries_more, queries_search, queries_service, queries_streams

QUERIES = {**queries_search.QUERIES, **queries_catalog.QUERIES, **queries_more.QUERIES, **queries_service.QUERIES, **queries_files.QUERIES, **queries_streams.QUERIES}
SQL = {**queries_search.SQL, **queries_catalog.SQL, **queries_more.SQL, **queries_service.SQL, **queries_files.SQL, **queries_streams.SQL}
