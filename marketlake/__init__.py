"""Tick, bar and market-structure analytics as Spark DataFrame transformations."""
