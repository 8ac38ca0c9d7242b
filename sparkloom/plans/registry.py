"""Every registered query, with its SQL where SQL can express it."""

from sparkloom.plans import graph, listing, more, retrieval, rollups, text, usage

QUERIES: dict = {}
ORACLES: dict = {}
for module in (usage, listing, rollups, text, retrieval, graph, more):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
