"""Readers of captures, spools and registries, and writers of reports and metrics."""
