"""Whole runs over files, reports and the registered queries."""
