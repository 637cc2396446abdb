"""Operators on DataFrames: dates, conditions, select lists, joins, writes, checks, changes."""
