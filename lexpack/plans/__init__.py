"""Queries over the driver's tables that apply the operators, each with the SQL that gives the same rows."""
