"""Wiring-graph analytics as Spark DataFrame operators."""
