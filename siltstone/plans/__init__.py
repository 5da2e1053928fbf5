"""The registered queries and the SQL that gives the same rows."""

from .oracles import ORACLES
from .queries import REGISTRY

__all__ = ["ORACLES", "REGISTRY"]
