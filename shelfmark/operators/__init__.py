"""Operators on whole tables: filters, joins, ranking, summaries."""
