"""Keyed, stateful message processing planned as Spark queries."""
