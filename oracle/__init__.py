"""SQL that computes the expected result of every query on the same tables."""
