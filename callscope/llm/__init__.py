"""Operators for preparing training corpora, their queries, and the SQL these must equal. Nothing else in the package imports this."""
