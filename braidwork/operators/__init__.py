"""Bulk operators on run positions; each works on all runs of a DataFrame."""
