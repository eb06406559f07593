"""DataFrame operators of the measurement engine."""
