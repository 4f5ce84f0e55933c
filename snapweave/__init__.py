"""snapweave: snapshot, task and app-store entity analytics on Spark.

Sub-packages:
  sources/    scans of captured snapshots, seeds, embedded JSON, feeds, pages
  functions/  Column-level processors, regexes and URL helpers (pure Catalyst)
  operators/  DataFrame operators: history/delta, dedupe/upsert, joins,
              merges, ranks, filters, graph expansion
  sinks/      JSONL / CSV / history writers
  streaming/  Structured Streaming versions of dedupe, upsert and delta
  plans/      the registered queries bound to the driver tables
"""

__version__ = "0.1.0"
