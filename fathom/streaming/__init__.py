"""Price bars from streams."""
