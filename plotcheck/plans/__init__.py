"""Registered queries: operators applied to the derived tables, with their SQL."""
