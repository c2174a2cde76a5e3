"""Editorial review: filters, pages with an exact total, filter options, feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.operators.articles import latest, merge


def review_filter(facts: DataFrame, since: str | None = None, until: str | None = None, outlet: str | None = None, country: str | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    """Facts within inclusive bounds; None is no bound. Plain predicates, so they reach the scan."""
    if least is not None and most is not None and least > most:
        raise ValueError("least importance is above the most")
    day = F.to_date("ingested")
    conditions = [
        None if since is None else day >= F.lit(since).cast("date"), None if until is None else day <= F.lit(until).cast("date"), None if outlet is None else F.col("outlet") == outlet,
        None if country is None else F.col("country") == country, None if least is None else F.col("importance") >= least, None if most is None else F.col("importance") <= most,
    ]
    return reduce(lambda df, c: df.where(c), [c for c in conditions if c is not None], facts)


def page(rows: DataFrame, number: int, size: int, *order) -> DataFrame:
    """One page (1-based) of an ordered table."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One row: total, pages, has_next, has_previous."""
    pages = F.ceil(F.col("total") / size)
    return rows.agg(F.count("*").alias("total")).select("total", pages.alias("pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def with_article(facts: DataFrame, articles: DataFrame) -> DataFrame:
    """facts (article_id, country, ..) with the article as a struct, and the country as an array."""
    embedded = articles.select(F.col("id").alias("article_id"), F.struct("outlet", "title").alias("article"))
    empty = F.struct(F.lit(None).cast("string").alias("outlet"), F.lit(None).cast("string").alias("title"))
    return facts.join(embedded, "article_id", "left").withColumn("article", F.coalesce("article", empty)).withColumn("country", F.array("country"))


def filter_options(facts: DataFrame) -> DataFrame:
    """(field, value): distinct outlets and countries of the whole table, and the bounds of importance (1 and 10 if there is none)."""
    values = lambda c: facts.where(F.col(c).isNotNull()).select(F.lit(c).alias("field"), F.col(c).alias("value")).distinct()
    bounds = facts.agg(F.coalesce(F.min("importance"), F.lit(1)).cast("string").alias("a"), F.coalesce(F.max("importance"), F.lit(10)).cast("string").alias("b"))
    return values("outlet").unionByName(values("country")).unionByName(bounds.select(F.expr("stack(2, 'least', a, 'most', b) as (field, value)")))


def feedback(stored: DataFrame, batch: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored feedback (fact, editor, importance, at) after a batch, one row a fact and editor; and rows whose fact is unknown."""
    known = batch.join(facts.select(F.col("id").alias("fact")), "fact", "left_semi")
    lost = batch.join(facts.select(F.col("id").alias("fact")), "fact", "left_anti")
    keyed = lambda df: df.withColumn("_key", F.concat_ws("#", "fact", "editor"))
    return merge(keyed(stored), latest(keyed(known), "_key", F.col("at")), "_key").drop("_key"), lost
