"""Numbers that are taken while a table is written."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation


def seen(observation: Observation, name: str, default: Any) -> Any:
    """An observed number after the write; ``default`` where the input turned out empty.

    Adaptive execution replaces a plan over nothing as a whole, with its observation.
    """
    try:
        value = observation.get[name]
    except Py4JJavaError:
        return default
    return default if value is None else value
