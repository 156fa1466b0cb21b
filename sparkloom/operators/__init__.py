"""operators of the intake analytics engine."""
