"""adperf: ad-performance analytics as Spark DataFrame, SQL and Structured Streaming jobs.

Layout:

- ``sources``   readers and writers: driver tables, adapter views, event stream, landed
                platform payloads, partitioned fact / insight storage
- ``functions`` column expressions: guarded ratios, dedup keys, date handling
- ``operators`` DataFrame -> DataFrame transforms: validation, dedup, roll-ups,
                insight queries, campaign changes, budget, quality audits
- ``plans``     multi-step batch jobs: ingest, re-aggregation, fetch-window planning
- ``streaming`` Structured Streaming ingest and the stateful TTL dedup
"""

from adperf.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
