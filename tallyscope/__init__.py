"""Ledger pattern analytics as Spark DataFrame operators."""
