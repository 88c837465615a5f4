"""Relational operators of the document model: pure functions of DataFrames."""
