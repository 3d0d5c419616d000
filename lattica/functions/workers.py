"""Functions for Python workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Send the module's functions to Python workers whole, so that executors needn't have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
