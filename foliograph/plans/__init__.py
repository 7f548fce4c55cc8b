"""Queries on the analytics tables and the SQL each one is checked against."""
