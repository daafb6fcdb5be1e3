"""Registered queries, each with the SQL it is checked against."""

from . import evaluation, features, relations, statistics  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
