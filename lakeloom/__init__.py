"""lakeloom: Spark ingestion and catalog analytics.

- ``lakeloom.plans``: the flows (ingest, delivery, catalog events → dictionary).
- ``lakeloom.sources``, ``lakeloom.functions``, ``lakeloom.operators`` and
  ``lakeloom.sinks``: the building blocks, plain ``DataFrame -> DataFrame``
  functions plus thin write/register helpers.
- ``lakeloom.streaming``: the same flows under Structured Streaming.
- ``lakeloom.session``: session settings and the shared work folder.
"""

__version__ = "0.1.0"
