"""Registered queries and the SQL that their results are held against."""
