"""Structured Streaming entry points.

The evaluated pipeline has no event-time semantics, but its replies arrive
asynchronously.  The reply parsing and scoring operators are stateless
column expressions, so the same code runs on a streaming DataFrame: replies
landing as files are parsed and scored incrementally and each micro-batch is
written to the iteration-partitioned result table.
"""
