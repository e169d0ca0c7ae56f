"""Registered queries by family, each with the SQL that its result must equal."""
