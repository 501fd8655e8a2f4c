"""Registered queries over the test tables and their oracle SQL."""
