"""Sources and sinks: SQLite files, key/value tables, snapshots of versioned databases."""
