"""The market queries by name, and their SQL counterparts."""

from . import charts, feeds, flows, payloads, prices, readers, reads, values, vendors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
