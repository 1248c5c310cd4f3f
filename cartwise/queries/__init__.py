"""All registered queries."""

from cartwise.queries import base, decide, marts, models, sequences, statistics  # noqa: F401
from cartwise.registry import ENTRIES

__all__ = ["ENTRIES"]
