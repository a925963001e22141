"""Threads and memory of Python workers."""

from __future__ import annotations


def one_thread() -> None:
    """Keep the linear algebra library, if it is one that can be told, from starting threads of its own: tasks fill the cores."""
    import ctypes

    with open("/proc/self/maps") as f:
        paths = {line.split()[-1] for line in f if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def release_memory() -> None:
    """Give back what a task has used: workers are kept for later tasks, which may be the JVM's alone."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
        library.malloc_trim(0)
