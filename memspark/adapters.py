"""Domain views over the generic test tables, each as Spark SQL and as the equal DuckDB SQL.

A deployment replaces these by its own tables of the same columns.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_TYPES = ("WORKS_ON", "MEMBER_OF", "ASSIGNED", "BLOCKS", "PART_OF", "ABOUT", "PRODUCED", "PARTICIPATED_IN", "RELATES_TO")
_TYPE_CASE = "CASE l_partkey % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " ELSE NULL END"

#: view -> (table, Spark columns, DuckDB columns, condition)
_SIMPLE = {
    "transcript": (
        "conversations",
        ["conv_id AS session_id", "turn AS seq",
         "CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant_text' ELSE 'system_prompt' END AS type", "text"],
        None, None,
    ),
    "wal": (
        "conversations",
        ["conv_id AS session_id", "turn AS seq",
         "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id AS INT), CAST(turn AS INT)) AS ts", "'memory-grade' AS record", "text"],
        ["conv_id AS session_id", "turn AS seq",
         "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INT)) + to_minutes(CAST(turn AS INT)) AS ts", "'memory-grade' AS record", "text"],
        None,
    ),
    "ledger": (
        "orders",
        ["o_orderkey AS entry_id", "o_custkey AS session_id", "o_orderdate AS ts", "o_orderpriority AS summary", "o_totalprice AS weight",
         "CASE o_orderstatus WHEN 'O' THEN 'no' WHEN 'P' THEN 'in-progress' ELSE 'done' END AS extracted"],
        None, None,
    ),
    "journal": (
        "events",
        ["event_id AS entry_id", "ts", "user_id AS scope", "value",
         "CASE event_type WHEN 'click' THEN 'gate-resolve' WHEN 'signup' THEN 'gate-flag' WHEN 'view' THEN 'verdict' "
         "WHEN 'purchase' THEN 'revert' ELSE 'worker-error' END AS action"],
        None, None,
    ),
    "task_events": (
        "events",
        ["user_id AS task_id", "event_id AS ordinal", "ts",
         "CASE event_type WHEN 'signup' THEN 'task.created' WHEN 'click' THEN 'task.due_moved' WHEN 'purchase' THEN 'task.done' ELSE 'task.cancelled' END AS event",
         "CASE WHEN event_type IN ('signup', 'click') AND event_id % 7 <> 0 THEN ts + make_dt_interval(CAST(value AS INT) % 30) END AS due",
         "CASE WHEN user_id % 3 = 0 THEN 'commitment' ELSE 'todo' END AS kind",
         "CASE WHEN user_id % 5 = 0 THEN NULL ELSE CONCAT('P', CAST(user_id % 11 AS STRING)) END AS project",
         "CASE WHEN event_id % 4 = 0 THEN '' ELSE CONCAT('t', CAST(event_id AS STRING)) END AS title"],
        ["user_id AS task_id", "event_id AS ordinal", "ts",
         "CASE event_type WHEN 'signup' THEN 'task.created' WHEN 'click' THEN 'task.due_moved' WHEN 'purchase' THEN 'task.done' ELSE 'task.cancelled' END AS event",
         "CASE WHEN event_type IN ('signup', 'click') AND event_id % 7 <> 0 THEN ts + to_days(CAST(trunc(value) AS INT) % 30) END AS due",
         "CASE WHEN user_id % 3 = 0 THEN 'commitment' ELSE 'todo' END AS kind",
         "CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'P' || CAST(user_id % 11 AS VARCHAR) END AS project",
         "CASE WHEN event_id % 4 = 0 THEN '' ELSE 't' || CAST(event_id AS VARCHAR) END AS title"],
        "event_type <> 'view'",
    ),
}

_EDGE = [
    "concat_ws('-', CAST(l_orderkey AS {s}), CAST(l_partkey AS {s}), CAST(l_suppkey AS {s}), CAST(l_linenumber AS {s})) AS edge_id",
    "l_orderkey AS episode", f"{_TYPE_CASE} AS type",
    "CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'N' THEN 'provisional' ELSE 'quarantined' END AS verdict",
    "l_suppkey % 7 = 0 AS contested", "o_orderdate AS valid_at",
    "CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS invalid_at",
    "CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN l_shipdate END AS expired_at",
    "concat('part ', CAST(l_partkey AS {s}), ' from supplier ', CAST(l_suppkey AS {s})) AS fact",
    "CASE WHEN l_suppkey % 5 = 0 THEN 'C3' WHEN l_suppkey % 5 = 1 THEN 'C4' ELSE 'C1' END AS class",
    "l_extendedprice AS weight",
]


class Views:
    """The domain views of one folder of tables, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # Python workers of this host import the package wherever the driver was started (a cluster gets it by --py-files)
        env = spark.sparkContext.environment
        parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _ROOT not in parts:
            env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _simple(self, name: str) -> DataFrame:
        table, columns, _, condition = _SIMPLE[name]
        rows = self.table(table)
        return (rows.where(condition) if condition else rows).selectExpr(*columns)

    @cached_property
    def transcript(self) -> DataFrame:
        return self._simple("transcript")

    @cached_property
    def wal(self) -> DataFrame:
        return self._simple("wal")

    @cached_property
    def ledger(self) -> DataFrame:
        return self._simple("ledger")

    @cached_property
    def journal(self) -> DataFrame:
        return self._simple("journal")

    @cached_property
    def task_events(self) -> DataFrame:
        return self._simple("task_events")

    @cached_property
    def edges(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_orderdate")
        joined = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.selectExpr(*(c.format(s="STRING") for c in _EDGE))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents")


def duck(*names: str) -> str:
    """WITH clause that defines the named views for DuckDB."""
    parts = []
    for n in names:
        if n == "edges":
            columns = ", ".join(c.format(s="VARCHAR") for c in _EDGE)
            parts.append(f"edges AS (SELECT {columns} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
        else:
            table, spark, own, condition = _SIMPLE[n]
            where = f" WHERE {condition}" if condition else ""
            parts.append(f"{n} AS (SELECT {', '.join(own or spark)} FROM {table}{where})")
    return "WITH " + ", ".join(parts)
