"""Windowed aggregates over event topics, their sinks, and the streaming jobs."""
