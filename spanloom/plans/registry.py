"""Queries of the span operators over the driver's tables, and the same in SQL."""

from __future__ import annotations

from . import fixtures, mentions, more, scores, sequences, spans, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (texts, spans, scores, sequences, fixtures, more, mentions):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
