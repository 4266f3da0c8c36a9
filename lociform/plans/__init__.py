"""Queries: operators bound to tables, with the SQL they are held against."""
