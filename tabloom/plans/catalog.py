"""All queries of the annotation engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.plans import q_data, q_eval, q_lookup, q_method, q_misc, q_prompt, q_rank, q_report, q_text, q_version

_ALL = [q_text, q_rank, q_eval, q_misc, q_lookup, q_method, q_data, q_prompt, q_version, q_report]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _ALL for name, (f, _) in m.CATALOG.items()}
SQL: dict[str, str] = {name: sql for m in _ALL for name, (_, sql) in m.CATALOG.items() if sql}
