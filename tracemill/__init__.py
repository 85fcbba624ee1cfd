"""Cluster-usage trace analytics as Spark plans."""

from tracemill.session import build_session

__all__ = ["build_session"]
