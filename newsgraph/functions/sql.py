"""Functions for SQL users, as temporary SQL functions: scalar ones inline into plans, table functions take parameters."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = [
    "CREATE OR REPLACE TEMPORARY FUNCTION has_dimension(v ARRAY<FLOAT>, n INT) RETURNS BOOLEAN RETURN coalesce(size(v) = n, false)",
    "CREATE OR REPLACE TEMPORARY FUNCTION clean_text(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, '\\\\s+', ' '))",
]
#: Table functions read a view that the caller registers.
TABLES = ["CREATE OR REPLACE TEMPORARY FUNCTION slow_users(least DOUBLE) RETURNS TABLE(user_id BIGINT, calls BIGINT, mean DOUBLE) RETURN SELECT user_id, count(*), avg(value) FROM query_log GROUP BY user_id HAVING avg(value) >= least"]


def register(spark: SparkSession) -> None:
    for definition in DEFINITIONS + (TABLES if spark.catalog.tableExists("query_log") else []):
        spark.sql(definition)
