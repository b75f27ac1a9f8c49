"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_token_store": "token_store",
    "op2_quality": "quality",
    "op3_bpe": "bpe",
    "op4_knn": "knn",
    "op5_language_id": "langid",
    "op6_packing": "packing",
    "op7_line_dedup": "line_dedup",
    "op8_url_filter": "url_filter",
    "op9_chat": "chat",
    "op10_simhash": "simhash",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"stranda.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f"stranda.llm.{module}") for name, module in MODULES.items()}
    return {name: m.SQL for name, m in modules.items() if hasattr(m, "SQL")}
