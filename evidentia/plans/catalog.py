"""All queries by name, and SQL for each where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans import answers, corpus, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **corpus.QUERIES, **answers.QUERIES}
ORACLE_SQL: dict[str, str] = {**retrieval.ORACLE_SQL, **corpus.ORACLE_SQL, **answers.ORACLE_SQL}
