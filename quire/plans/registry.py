"""All queries over the engine's operators, by name, and the SQL they are checked against."""

from __future__ import annotations

from . import events, explore, lists, matching, more, records, shapes, structure, words  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "ngram_decade"
