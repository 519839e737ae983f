"""The registered queries of the library, by area, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from contactsheet.adapter import Library

AREAS = ("grid", "time", "similarity", "upkeep", "pages", "workflow", "views", "searches", "scans", "evidence")


def registry(queries: dict, oracle: dict[str, str], with_: str):
    """A decorator that registers a function of a ``Library`` under its name, with the SQL that gives the same rows."""

    def query(sql: str = "", recursive: bool = False):
        def register(make: Callable[[Library], DataFrame]):
            queries[make.__name__] = lambda spark, folder: make(Library(spark, folder))
            if sql:
                oracle[make.__name__] = (with_.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else with_) + sql
            return make

        return register

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for area in AREAS for k, v in import_module(f"contactsheet.plans.{area}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for area in AREAS for k, v in import_module(f"contactsheet.plans.{area}").ORACLE_SQL.items()}
