"""A PySpark engine for time-domain stellar photometry."""

__version__ = "0.1.0"
