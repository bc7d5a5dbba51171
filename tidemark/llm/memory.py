"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import gc


def give_back() -> None:
    """Return freed memory to the system where the C library can; a worker would else hold its largest task's for good."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
