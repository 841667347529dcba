"""Registered queries and their SQL."""

from . import extra as _extra  # noqa: F401  adds its queries
from . import more as _more  # noqa: F401  adds its queries
from . import runs as _runs  # noqa: F401  adds its queries
from . import search as _search  # noqa: F401  adds its queries
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
