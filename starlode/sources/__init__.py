"""Sources and sinks: image files, catalogue datasets and tables."""
