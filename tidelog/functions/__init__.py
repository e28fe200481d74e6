"""Column expressions of the event log."""
