"""Every registered query with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselark.plans import fields, grids, streams, tilings, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**grids.QUERIES, **tokens.QUERIES, **fields.QUERIES, **tilings.QUERIES, **streams.QUERIES}
SQL: dict[str, str] = {**grids.SQL, **tokens.SQL, **fields.SQL, **tilings.SQL, **streams.SQL}
