"""All queries of the consolidation operators and their SQL."""

from tagloom.plans import block_queries, code_queries, label_queries, match_queries, price_queries, progressive_queries, stream_queries, vote_queries

_PLANS = (vote_queries, match_queries, block_queries, code_queries, label_queries, price_queries, progressive_queries, stream_queries)
QUERIES: dict = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
