"""Registered queries; importing the modules fills the registry."""

from lodestar.plans.registry import QUERIES, Tables, oracles  # noqa: F401
from lodestar.plans import changes, contents, documents, listings, models, series  # noqa: F401
