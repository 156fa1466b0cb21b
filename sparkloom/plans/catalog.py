"""All queries: importing the modules registers theirs."""

from __future__ import annotations

from sparkloom.plans import aliases, contracts, exports, files, identities, ledgers, packets, quality, queues, reports, runs, scoring, streams, timeseries, traces, workflow  # noqa: F401
from sparkloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
