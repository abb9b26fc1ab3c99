"""deskline: service-desk analytics as Spark DataFrame operators.

Sub-packages:
  functions/  Column expressions (stamp parsing, labels, text helpers)
  operators/  DataFrame -> DataFrame operators (tickets, KPIs, contracts, devices, documents, upserts)
  sources/    table loading, JSON feed readers, snapshot sinks
  plans/      the registered queries and their DuckDB oracle SQL
  streaming/  Structured Streaming ingest jobs
"""

from deskline.session import ensure_session, scratch_dir

__all__ = ["ensure_session", "scratch_dir"]
