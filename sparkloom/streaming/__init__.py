"""streaming of the intake analytics engine."""
