"""Continuous forms of batch operators, for tables that arrive as streams. Additions: the batch operators are the contract."""
