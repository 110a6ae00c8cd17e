"""Whole plans: catalogs from tables, analytics over catalogs, the registered queries."""
