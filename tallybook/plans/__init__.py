"""Registered queries, grouped by topic."""
