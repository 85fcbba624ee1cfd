"""DataFrame operators. Column names are parameters that default to the trace names."""
