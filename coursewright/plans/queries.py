"""All registered queries of the catalog engine and their SQL."""

from __future__ import annotations

from coursewright.plans import catalog_queries, more_queries, report_queries, text_queries

QUERIES = {**catalog_queries.Q, **text_queries.Q, **more_queries.Q, **report_queries.Q}
ORACLES = {**catalog_queries.SQL, **text_queries.SQL, **more_queries.SQL, **report_queries.SQL}
