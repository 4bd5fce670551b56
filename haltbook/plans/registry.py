"""The registered queries of the library's operators and their DuckDB SQL."""

from __future__ import annotations

from haltbook.plans import q_assets, q_events, q_io, q_more, q_notices, q_pairing, q_report

QUERIES: dict = {}
ORACLES: dict = {}
for part in (q_pairing, q_report, q_notices, q_assets, q_events, q_io, q_more):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
