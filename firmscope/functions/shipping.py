"""Make Python code that runs inside tasks independent of how workers are launched.

Functions of the modules registered here are pickled *by value* (PySpark's cloudpickle),
so executors need numpy/pandas/pyarrow but not this package on their path.
"""

from __future__ import annotations

import sys


def ship_by_value(module_name: str) -> None:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])
