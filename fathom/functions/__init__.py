"""Functions on columns and on scalars."""
