"""Operators on panels: each a plan from DataFrame to DataFrame."""
