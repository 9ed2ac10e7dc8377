"""Shared names of the temporal, store, review and relevance queries."""

from __future__ import annotations

from ..sources import driver_tables as T

DAY = "1998-06-17"
CARD_DAY = "2024-03-15"
EV, RO, CA = T.EVENTS_SQL, T.ROSTER_SQL, T.CARDS_SQL
