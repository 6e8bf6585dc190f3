"""Every query of the library but those of ``llm``, and its oracle SQL."""

from . import analytics_queries, desk_queries, model_queries, panel_queries, report_queries

_PARTS = (panel_queries, analytics_queries, model_queries, desk_queries, report_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.Q.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.SQL.items()}
