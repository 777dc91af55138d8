"""Registry of the spatial queries and their SQL."""

from __future__ import annotations

from terralith.plans import analysis, derived, exchange, inference, overlays, predictive, rasters, regressions, risk, shapes, spatial, streams, tables

_MORE = (shapes.queries, rasters.queries, inference.queries, tables.queries, risk.queries, derived.queries, overlays.queries, predictive.queries, regressions.queries, exchange.queries)


def queries() -> dict:
    out = spatial.QUERIES | analysis.QUERIES | streams.QUERIES
    for r in _MORE:
        out |= r.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = spatial.ORACLES | analysis.ORACLES | streams.ORACLES
    for r in _MORE:
        out |= r.sql
    return out


def entry(spark, sf_dir: str):
    return spatial.points_per_district(spark, sf_dir)
