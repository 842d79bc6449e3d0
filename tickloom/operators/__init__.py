"""Operators on DataFrames of frames, messages, orders, levels, snapshots and findings."""
