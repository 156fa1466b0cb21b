"""plans of the intake analytics engine."""
