"""Operators for training-data pipelines: text, token, conversation and vector data.

Nothing outside this subpackage imports it.
"""

import ctypes

import pyarrow as pa

try:
    # Workers live on between tasks: large arrays come from pages of their own, which go back when they are freed.
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    _libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())
except (AttributeError, OSError):  # another C library
    pass
