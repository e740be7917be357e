"""Sources of rows."""
