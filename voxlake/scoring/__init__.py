"""Scores of calls."""
