"""Every query of the engine by name, with its oracle SQL."""

from __future__ import annotations

from . import cases  # noqa: F401 - registers its queries
from . import queries as q


def flagship(spark, sf_dir):
    return q.reconcile_flagship(spark, sf_dir)


def queries():
    return dict(q.QUERIES)


def oracle_sql():
    return dict(q.ORACLES)
