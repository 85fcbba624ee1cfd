"""Trace tables, event topics and the replay feed."""
