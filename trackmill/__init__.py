"""Readiness analytics for recorded movement data, as Spark DataFrame operators."""
