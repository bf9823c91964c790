"""Registered queries with the SQL that states their results."""
