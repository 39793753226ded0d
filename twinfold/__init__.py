"""Snapshot reconciliation and single-table audit as Spark jobs."""

__all__ = ["functions", "sources", "operators", "plans", "policy"]
