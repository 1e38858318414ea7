"""Structured Streaming forms of the daily counts (T1), the first-action
filter (T2) and the quota (T3)."""
