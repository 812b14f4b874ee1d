"""Registered plans: every operator over whole tables."""

from . import compare, engineering, extraction, features, flights, health, lifetime, reports, series, status

_FAMILIES = (status, lifetime, series, compare, health, engineering, features, extraction, reports, flights)
QUERIES = {name: query for family in _FAMILIES for name, query in family.PLANS.queries.items()}
SQL = {name: sql for family in _FAMILIES for name, sql in family.PLANS.sql.items()}
