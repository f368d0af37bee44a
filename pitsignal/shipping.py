"""Let Python functions reach executors without the package being installed there."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of a module by value, so workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
