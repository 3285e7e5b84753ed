"""Equity research on thinly traded markets as Spark plans."""
