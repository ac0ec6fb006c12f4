"""Tables, snapshots and JSON-lines files."""
