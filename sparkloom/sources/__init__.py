"""sources of the intake analytics engine."""
