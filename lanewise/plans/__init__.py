"""Logical plans shared by operators: the ledger and its dialects."""
