"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from strandmill.plans import file_queries, group_queries, interval_queries, molecule_queries, pair_queries, sequence_queries, statistic_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (sequence_queries, interval_queries, molecule_queries, pair_queries, statistic_queries, group_queries, file_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
