"""DataFrame operators of the event log."""
