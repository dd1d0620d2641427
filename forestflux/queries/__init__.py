"""All registered queries of the engine."""

from . import emissions, lidar, series, space, training  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
