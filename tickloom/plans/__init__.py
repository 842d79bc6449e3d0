"""Queries over the test tables, which are mapped to feeds, and the SQL that each is held against."""
