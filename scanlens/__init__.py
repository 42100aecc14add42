"""scanlens — incremental image-text index and search on Spark DataFrames.

Layout:
  functions/  Column builders (folding, globs, predicates, checks) — no actions, no UDFs
  sources/    table views, file listing, header probes
  operators/  store (change detection, upsert, cleanup), grams, search, layout, recognition
  plans/      whole jobs composed from the operators (index run, search run)
  streaming/  continuous ingestion with Structured Streaming
"""

__version__ = "0.1.0"
