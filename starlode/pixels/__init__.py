"""NumPy kernels on single frames, run inside one task per frame."""
