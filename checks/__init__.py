"""Corpora derived from the test tables, the registered queries over them, and their oracle SQL."""
