"""Sources and artifacts."""
