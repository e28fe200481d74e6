"""Log store, control tables, segment files and the request gateway."""
