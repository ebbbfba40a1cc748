"""lodestar: fund and ETF analytics as Spark DataFrame operators."""

from lodestar.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
