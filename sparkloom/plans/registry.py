"""Name to query, and name to the SQL that gives the same rows."""

from __future__ import annotations

from sparkloom.plans.oracles import ORACLE_SQL
from sparkloom.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
