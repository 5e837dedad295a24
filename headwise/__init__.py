"""Rider time loss from transit schedules and observed stop arrivals, on Spark."""
