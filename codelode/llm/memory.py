"""Memory of Python workers, which outlive their tasks."""

import ctypes
import functools

import pyarrow as pa


def release() -> None:
    """Hand memory that nothing uses back to the system, as far as the platform allows."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its own habits hold
        pass


def tidy(function):
    """A function from batches to batches that releases memory when its task ends, however it ends."""

    @functools.wraps(function)
    def run(batches):
        made = function(batches)
        try:
            yield from made
        finally:
            made.close()
            del made
            release()

    return run
