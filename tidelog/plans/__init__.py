"""Named queries over the event log, with their SQL."""
