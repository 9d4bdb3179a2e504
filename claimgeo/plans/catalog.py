"""Registered queries: one per operator of SURVEY §2, each with its oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator on the
bindings of ``sf_dir`` over whole tables. ``ORACLE[name]`` is the same
question in DuckDB SQL against the raw tables (views restated in
:mod:`oracle_views`); every query here has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Bindings

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def bind(spark: SparkSession, sf_dir: str) -> Bindings:
    return Bindings(spark, sf_dir)


# Importing the modules fills the registries.
from . import q_aggregate, q_geo, q_quality, q_rates, q_sources, q_stream  # noqa: E402,F401
