"""Queries over the star-schema tables: each shows operators on them, next to the SQL that must give the same rows."""

from gustline.plans import casefile, catalog, evaluate, fits, gridded, metric, ordered, panel, periods, prepare, protocol, registers, roles, split
from gustline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "casefile", "catalog", "evaluate", "fits", "gridded", "metric", "ordered", "panel", "periods", "prepare", "protocol", "registers", "roles", "split"]
