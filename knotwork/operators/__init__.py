"""Operators over plain column-value records and graphs; each takes and returns DataFrames."""
