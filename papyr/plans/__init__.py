"""All registered queries over the platform's tables, and their DuckDB SQL."""

from papyr.plans import field_queries, optional_queries, page_queries, platform_queries, retrieval_queries, text_queries

QUERIES, SQL = {}, {}
for _module in (text_queries, field_queries, retrieval_queries, page_queries, platform_queries, optional_queries):
    QUERIES |= _module.Q
    SQL |= _module.O
