"""Operators for large training corpora. Nothing outside this folder imports it but __spark_entry__ (guarded)."""
