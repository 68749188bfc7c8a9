"""One BLAS thread a process.

Spark starts processes by forking, after which a threaded BLAS may wait forever
for its threads; and each task has one core. Called before dense algebra.
"""

from __future__ import annotations

import ctypes
import glob
import os

_done: set[int] = set()
#: Names under which OpenBLAS builds export their thread setting.
_NAMES = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads")


def one_thread() -> None:
    """Set the thread number of the BLAS that NumPy loads to one, once a process."""
    if os.getpid() in _done:
        return
    _done.add(os.getpid())
    import numpy

    home = os.path.dirname(numpy.__file__)
    for lib in glob.glob(f"{home}.libs/*openblas*") + glob.glob(f"{home}/.libs/*openblas*"):
        loaded = ctypes.CDLL(lib)
        for name in _NAMES:
            if hasattr(loaded, name):
                getattr(loaded, name)(1)
                return
