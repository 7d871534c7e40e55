"""Relational operators over measurement, frame and catalogue tables."""
