"""Operators for large text corpora: filtering, joining, counting and laying out training data."""
