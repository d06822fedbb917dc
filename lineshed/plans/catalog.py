"""All registered queries; importing this module registers them."""

from lineshed.plans import information, reference, solvers, spectra, tables  # noqa: F401
from lineshed.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
