"""Whole runs, their options, and the catalogue of queries."""
