"""Registered queries on the SQL surface: table functions and scalar functions that SQL users call."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.functions import sql, tables
from newsgraph.plans import model
from newsgraph.registry import query


@query("""SELECT user_id, count(*) AS calls, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING avg(value) >= 50""")
def sql_table_function(spark, sf_dir):
    model.table(spark, sf_dir, "events").createOrReplaceTempView("query_log")
    sql.register(spark)
    return spark.sql("SELECT user_id, calls, round(mean, 6) AS mean FROM slow_users(50)")


@query("SELECT vec_id, len(embedding) = 64 AS fits FROM embeddings")
def sql_scalar_function(spark, sf_dir):
    sql.register(spark)
    return model.table(spark, sf_dir, "embeddings").select("vec_id", F.expr("has_dimension(embedding, 64)").alias("fits"))


@query("""SELECT event_type AS category, count(*) AS total, count(*) FILTER (user_id % 3 = 0) AS successful, count(*) FILTER (user_id % 3 = 1) AS failed, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last FROM events GROUP BY 1""")
def sql_migration_stats(spark, sf_dir):
    """A table function with a table argument, dealt by category; its rows are summed by day before."""
    model.table(spark, sf_dir, "events").createOrReplaceTempView("events_log")
    tables.register(spark)
    return spark.sql("""SELECT category, total, successful, failed, date_format(last_execution, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS last FROM migration_stats(TABLE(
      SELECT event_type AS category, CASE user_id % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE 'RUNNING' END AS status, CAST(max(ts) AS TIMESTAMP) AS executed_at, count(*) AS n FROM events_log GROUP BY 1, 2, date(ts)))""")


@query("""WITH v AS (SELECT 'user' || user_id AS name, count(*) FILTER (event_type = 'error') AS rows, sum(value * 1000)::BIGINT AS bytes, max(ts) FILTER (event_type <> 'view') AS refreshed FROM events GROUP BY 1),
h AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(refreshed)) / 3600000000.0 AS hours FROM v)
SELECT name, rows, CASE WHEN hours IS NULL THEN 'critical' WHEN rows = 0 OR bytes > 5000000 OR hours > 24 THEN 'warning' ELSE 'healthy' END AS status,
  CASE WHEN hours IS NULL THEN 'never refreshed' WHEN rows = 0 THEN 'no rows' WHEN bytes > 5000000 THEN 'over 5000000 bytes' WHEN hours > 24 THEN floor(hours)::BIGINT || ' hours old' ELSE '' END AS message FROM h""")
def sql_view_health(spark, sf_dir):
    """Users' events stand for views: errors are rows, what isn't a view is a refresh."""
    model.table(spark, sf_dir, "events").createOrReplaceTempView("events_log")
    tables.register(spark)
    return spark.sql("""SELECT * FROM view_health(TABLE(SELECT concat('user', user_id) AS name, count_if(event_type = 'error') AS rows, CAST(sum(CAST(value * 1000 AS DECIMAL(20, 6))) AS BIGINT) AS bytes,
      CAST(max(CASE WHEN event_type <> 'view' THEN ts END) AS TIMESTAMP) AS refreshed FROM events_log GROUP BY 1), '2024-01-31T00:00:00', 24, 5000000)""")


@query("""SELECT p_type, count(*) AS rows, count(*) FILTER (p_size NOT BETWEEN 5 AND 45) AS p_size_invalid, count(*) FILTER (p_retailprice NOT BETWEEN 900 AND 2000) AS p_retailprice_invalid,
  count(*) FILTER (p_size NOT BETWEEN 5 AND 45) = 0 AND count(*) FILTER (p_retailprice NOT BETWEEN 900 AND 2000) = 0 AS passed FROM part GROUP BY 1""")
def sql_validation_report(spark, sf_dir):
    """Its columns follow from the rules."""
    model.table(spark, sf_dir, "part").createOrReplaceTempView("parts_checked")
    tables.register(spark)
    return spark.sql("""SELECT * FROM validation_report(TABLE(parts_checked), 'p_type', '{"p_size": [5, 45], "p_retailprice": [900, 2000]}')""")
