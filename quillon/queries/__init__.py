"""Registered queries, one for each operator, and the SQL they are checked against."""
