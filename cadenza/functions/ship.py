"""Functions run in Python workers travel by value, so that executors need no copy of the library."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(name: str) -> None:
    """Call at the end of a module whose functions run in workers."""
    cloudpickle.register_pickle_by_value(sys.modules[name])
