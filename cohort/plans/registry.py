"""Query and oracle registry used by ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cohort.plans import queries, queries2
    out = dict(queries.QUERIES)
    out.update(queries2.QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    from cohort.plans import oracle, oracle2
    out = dict(oracle.ORACLE)
    out.update(oracle2.ORACLE)
    q = all_queries()
    return {k: v for k, v in out.items() if k in q}
