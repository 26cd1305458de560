"""Readers and writers for ledger files and tables."""
