"""Operators: DataFrames in, DataFrames out.

Linear algebra keeps to one thread of a process: a task owns one core, and a driver that has forked (to start its JVM, say) can
wait for ever for the threads that its numerical library had before.
"""

import ctypes
import glob
import os

import numpy

for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
# Where numpy was loaded before, its own library has read these already.
for _path in glob.glob(f"{os.path.dirname(os.path.dirname(numpy.__file__))}/numpy.libs/*openblas*"):
    if _set := getattr(ctypes.CDLL(_path), "scipy_openblas_set_num_threads64_", None):
        _set(1)
