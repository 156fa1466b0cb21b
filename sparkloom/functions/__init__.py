"""functions of the intake analytics engine."""
