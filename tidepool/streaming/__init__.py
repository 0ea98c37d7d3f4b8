"""Streams: ingest, indexing, activity and findings per period, the client gate, the change feed."""
