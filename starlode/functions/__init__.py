"""Column expressions: photometric scalars, sky geometry and frame headers."""
