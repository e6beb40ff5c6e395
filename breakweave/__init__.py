"""Interval and breakpoint-graph analytics on Spark."""
