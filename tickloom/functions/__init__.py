"""Column functions: wire layouts, little-endian readers and writers, and the rule catalogue."""
