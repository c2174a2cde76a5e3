"""Table functions that take a table: SELECT * FROM migration_stats(TABLE(history)). The schema, and how the table is dealt, follow from the arguments.

    tables.register(spark)

A partition's rows come one by one, and only counts are held. Each partition gives its own row, so tables with a key that
holds most rows are better aggregated with SQL first; the functions take sums as well (a column `n`, rows that a row stands for).
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, LongType, StringType, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn


def _need(table: AnalyzeArgument, *columns: str) -> list[str]:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name) or TABLE(SELECT ..)")
    names = table.dataType.fieldNames()
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return names


def _count(row) -> int:
    return row["n"] if "n" in row else 1


class MigrationStats:
    """category, total, successful, failed, last_execution of a table (category, status, executed_at); dealt by category."""

    @staticmethod
    def analyze(history: AnalyzeArgument) -> AnalyzeResult:
        _need(history, "category", "status", "executed_at")
        schema = StructType().add("category", StringType()).add("total", LongType()).add("successful", LongType()).add("failed", LongType()).add("last_execution", TimestampType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("category")])

    def __init__(self) -> None:
        self.category, self.total, self.good, self.bad, self.last = None, 0, 0, 0, None

    def eval(self, row) -> None:
        n, at = _count(row), row["executed_at"]
        self.category = row["category"]
        self.total += n
        self.good += n * (row["status"] == "SUCCESS")
        self.bad += n * (row["status"] == "FAILED")
        self.last = at if self.last is None or at is not None and at > self.last else self.last

    def terminate(self):
        if self.total:
            yield self.category, self.total, self.good, self.bad, self.last


class ViewHealth:
    """name, rows, status, message of a table (name, rows, bytes, refreshed) and a moment (text): without rows or over `most` bytes a warning, older than `stale` hours as well, never refreshed critical. A row gives a row."""

    @staticmethod
    def analyze(views: AnalyzeArgument, now: AnalyzeArgument, stale: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        _need(views, "name", "rows", "bytes", "refreshed")
        return AnalyzeResult(StructType().add("name", StringType()).add("rows", LongType()).add("status", StringType()).add("message", StringType()))

    def eval(self, row, now: str, stale: int = 6, most: int = 1 << 30):
        from datetime import datetime

        at = row["refreshed"]
        hours = None if at is None else (datetime.fromisoformat(now) - at.replace(tzinfo=None)).total_seconds() / 3600
        if hours is None:
            status, message = "critical", "never refreshed"
        elif not row["rows"]:
            status, message = "warning", "no rows"
        elif row["bytes"] > most:
            status, message = "warning", f"over {most} bytes"
        elif hours > stale:
            status, message = "warning", f"{int(hours)} hours old"
        else:
            status, message = "healthy", ""
        yield row["name"], row["rows"], status, message


class ValidationReport:
    """Rows that break each rule, per value of a column: a column for each rule, and passed. rules is JSON, {column: [low, high]}; nulls break a rule."""

    @staticmethod
    def analyze(table: AnalyzeArgument, by: AnalyzeArgument, rules: AnalyzeArgument) -> AnalyzeResult:
        found = json.loads(rules.value)
        _need(table, by.value, *found)
        schema = StructType().add(by.value, table.dataType[by.value].dataType).add("rows", LongType())
        for column in found:
            schema = schema.add(f"{column}_invalid", LongType())
        return AnalyzeResult(schema=schema.add("passed", BooleanType()), partitionBy=[PartitioningColumn(by.value)])

    def __init__(self) -> None:
        self.key, self.rows, self.bad, self.rules = None, 0, {}, None

    def eval(self, row, by: str, rules: str) -> None:
        if self.rules is None:
            self.rules = json.loads(rules)
            self.bad = dict.fromkeys(self.rules, 0)
        n = _count(row)
        self.key, self.rows = row[by], self.rows + n
        for column, (low, high) in self.rules.items():
            value = row[column]
            self.bad[column] += n * (value is None or not low <= value <= high)

    def terminate(self):
        if self.rows:
            yield self.key, self.rows, *self.bad.values(), not any(self.bad.values())


FUNCTIONS = {"migration_stats": MigrationStats, "view_health": ViewHealth, "validation_report": ValidationReport}


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
