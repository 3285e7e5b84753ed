"""Whole studies, their reports, and the registered queries."""
