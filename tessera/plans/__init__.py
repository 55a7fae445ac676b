"""Composed plans and the registry of queries over them."""

from tessera.plans import browse, catalogues, details, feeds, maintenance, places, reports, rules, search, sqlrules, streams, views, writes  # noqa: F401  each module registers its queries
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
