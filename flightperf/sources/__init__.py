"""Flight sources (CSV, directories, zip archives, test-data mapping) and sinks."""
