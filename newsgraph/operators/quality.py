"""Data quality: completeness, counters, orphans, outliers, constraints, and the overall score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: total, and for each column the percentage that isn't null (null on an empty table), from one pass."""
    share = lambda c: F.round(F.try_divide(F.count(c) * 100.0, F.count("*")), 2).alias(f"{c}_percent")
    return df.agg(F.count("*").alias("total"), *[share(c) for c in columns])


def counters(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with how many rows each condition holds for, from one pass."""
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, broken): rows that break a rule, with the names of all that they break. A null value breaks none."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, broken.alias("broken")).where(F.size("broken") > 0)


def domain_rules(**columns: str) -> dict[str, Column]:
    """Rules of the model's domains, for the columns that stand for them: relevance, grade, confidence, url, country, vector, percent, importance."""
    of = {
        "relevance": lambda c: c.between(0, 10), "grade": lambda c: c.between(1, 5), "confidence": lambda c: c.between(0, 1), "url": lambda c: c.rlike(r"^https?://[^\s/$.?#].[^\s]*$"), "country": lambda c: c.rlike("^[A-Z]{2}$"),
        "vector": lambda c: F.size(c) == 384, "percent": lambda c: c.between(0, 100), "importance": lambda c: c.between(1, 10),
    }
    return {name: of[name](F.col(column)) for name, column in columns.items()}


def date_counters(moment: Column, now: Column, state: Column | None = None) -> dict[str, Column]:
    """Conditions for counters: dates in the future and before 1990, the last 7, 30 and 90 days, and states that tell of an error."""
    days = {f"last_{n}d": moment >= now - F.make_dt_interval(F.lit(n)) for n in (7, 30, 90)}
    out = {"future": moment > now, "ancient": moment < F.lit("1990-01-01").cast("timestamp")} | days
    return out | ({"with_errors": state.startswith("error"), "complete": state == "completado"} if state is not None else {})


def overdue(end: Column, now: Column, state: Column) -> Column:
    """A planned event that is over and neither done nor cancelled."""
    return (end < now) & ~state.isin("realizado", "cancelado")


def orphans(edges: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(edge, orphans): per name, rows of a child table whose non-null reference has no parent: (child, column, parent, key)."""

    def one(name: str, child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
        asked = child.where(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
        return asked.join(parent.select(F.col(key).alias("_k")), "_k", "left_anti").agg(F.lit(name).alias("edge"), F.count("*").alias("orphans"))

    return reduce(DataFrame.unionByName, [one(name, *edge) for name, edge in edges.items()])


def duplicate_urls(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.count(column) - F.countDistinct(column)).alias("duplicate_urls"))


def score(row: DataFrame, corrected: bool = False) -> DataFrame:
    """A one-row frame of counts (orphans, invalid, inconsistent, duplicate_urls, completeness: a sum of four percentages,
    content_percent, and embedding_percent if it is known) with score, level and advice. By default full data lowers the score, as the model has it; corrected turns that round."""
    missing = (400 - F.col("completeness")) / 20 if corrected else F.col("completeness") / 20
    raw = 100 - F.col("orphans") * 2 - F.col("invalid") - F.col("inconsistent") * 3 - F.col("duplicate_urls") * 0.5 - missing
    value = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)).cast("decimal(20,6)"), 0).cast("int")
    faults = F.col("orphans") + F.col("invalid") + F.col("inconsistent")
    content = F.col("content_percent")
    level = F.when((faults == 0) & (content >= 95), "excelente").when((faults <= 5) & (content >= 90), "buena").when((faults <= 20) & (content >= 80), "aceptable").otherwise("necesita_atencion")
    embedded = F.coalesce(F.col("embedding_percent") < 50, F.lit(False)) if "embedding_percent" in row.columns else F.lit(False)
    advice = F.when(F.col("orphans") > 0, "corregir_referencias").when(F.col("invalid") > 0, "validar_rangos").when(F.col("inconsistent") > 0, "revisar_fechas").when(embedded, "mejorar_embeddings").when(F.col("duplicate_urls") > 10, "revisar_duplicados").otherwise("en_buen_estado")
    return row.withColumns({"score": value, "level": level, "advice": advice})
