"""Queries over the given tables, one per operator, each with the SQL that states its result."""
