"""Training-data pipeline operators on Spark: scoring, packing, deduplication, token output.

Nothing outside this folder imports it.  The queries that apply these operators to whole tables are
in ``llm.queries``.
"""
