"""firmscope — company search and analytics as Spark DataFrame jobs.

Public API (the repository methods of the reference plus the batch jobs around them):
``search``, ``batch_search``, ``two_stage_retrieval``, ``add_tags``, ``all_tags``,
``ingest_companies``, ``resolve_intents``, ``synthesize_leads``, ``label_ttl_hits``,
``latency_report``.
"""

__version__ = "0.1.0"
