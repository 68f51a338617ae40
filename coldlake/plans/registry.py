"""All registered queries: name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL | None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coldlake.plans.catalog import Catalog
from coldlake.session import REQUIRED_CONF

_CATALOGS: dict[tuple[str, str], Catalog] = {}


def catalog_for(spark: SparkSession, sf_dir: str) -> Catalog:
    """One catalog per (session, folder), so a materialized catalog serves later queries.

    The settings results depend on (UTC session time zone, ANSI arithmetic, AQE) are
    applied to whatever session the caller passes in.
    """
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        _CATALOGS[key] = Catalog(spark, sf_dir)
    return _CATALOGS[key]


def _entries() -> dict[str, tuple]:
    from coldlake.plans import registry_live, registry_ops, registry_sales, registry_store
    out: dict[str, tuple] = {}
    out.update(registry_ops.QUERIES)
    out.update(registry_sales.QUERIES)
    out.update(registry_store.QUERIES)
    out.update(registry_live.QUERIES)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(catalog_for(spark, sf_dir))
    return {name: bind(fn) for name, (fn, _) in sorted(_entries().items())}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in sorted(_entries().items()) if sql is not None}
