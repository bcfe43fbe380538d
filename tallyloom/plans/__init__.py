"""Queries over the driver's tables: fixtures, plans and their SQL."""
