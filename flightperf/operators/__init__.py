"""Relational operators: classification, filters, rollups, joins, reshapes."""
