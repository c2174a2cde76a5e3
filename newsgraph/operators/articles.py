"""Article rows: coercion, validation, quarantine, merge by key, sitemap and pending filters, run statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.functions import text as tx

STATES = ("pendiente", "procesando", "completado", "error")
DEFAULTS = {"country": "desconocido", "media": "digital", "language": "es", "state": "pendiente", "opinion": False}


def coerce(df: DataFrame) -> DataFrame:
    """Known kinds of media and states, comma lists to arrays, JSON texts to maps, defaults for missing values; columns that are absent are passed over."""
    have, out = set(df.columns), df
    if "media" in have:
        out = out.withColumn("media", F.when(F.col("media").isNotNull(), tx.media_type(F.col("media"))))
    if "state" in have:
        out = out.withColumn("state", F.when(F.col("state").isin(*STATES), F.col("state")).when(F.col("state").isNotNull(), "pendiente"))
    if "tags" in have and dict(df.dtypes)["tags"] == "string":
        out = out.withColumn("tags", tx.list_items(F.col("tags")))
    if "metadata" in have and dict(df.dtypes)["metadata"] == "string":  # what is no JSON object becomes an empty map
        out = out.withColumn("metadata", F.when(F.col("metadata").isNotNull(), F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))))
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in have})


def errors(df: DataFrame, title: int = 10, body: int = 100) -> Column:
    """Names of all rules that a row breaks."""
    have = set(df.columns)
    missing = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    rules = {f"missing_{c}": missing(c) for c in ("url", "title", "outlet", "body") if c in have}
    rules |= {f"short_{c}": ~missing(c) & (F.length(F.trim(c)) < n) for c, n in (("title", title), ("body", body)) if c in have}
    if "url" in have:
        rules["bad_url"] = ~missing("url") & ~F.col("url").rlike(r"^https?://[^\s/]+")
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def split_valid(df: DataFrame, title: int = 10, body: int = 100) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and a quarantine of the others with their errors, the first as error_type, and a hint of the title."""
    marked = df.withColumn("errors", errors(df, title, body))
    bad = marked.where(F.size("errors") > 0).withColumn("error_type", F.col("errors")[0]).withColumn("hint", F.substring("title", 1, 30))
    return marked.where(F.size("errors") == 0).drop("errors"), bad


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key, nulls before all values; found map-side, so no task sorts a key's rows."""
    last = F.max_by(F.struct(*df.columns), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    return df.groupBy(F.col(key).alias("_key")).agg(last.alias("_last")).select("_last.*")


def merge(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Upsert: one row a key; the batch's values where not null, else the stored ones. The batch has one row a key."""
    columns = [c for c in stored.columns if c != key]
    old, new = stored.select(F.col(key).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in columns]), batch.select(F.col(key).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in columns if c in batch.columns])
    joined = old.join(new, F.col("_old") == F.col("_new"), "full")
    value = lambda c: F.coalesce(f"_n_{c}", f"_o_{c}") if c in batch.columns else F.col(f"_o_{c}")
    return joined.select(F.coalesce("_new", "_old").alias(key), *[value(c).alias(c) for c in columns])


def update(stored: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows with the changes of their key, and changes that found no row."""
    known = changes.join(stored.select(key), key, "left_semi")
    return merge(stored, known, key), changes.join(stored.select(key), key, "left_anti")


def sitemap(entries: DataFrame, since: str, column: str = "lastmod") -> DataFrame:
    """Entries changed since a moment; those without a readable moment pass."""
    moment = F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")])
    return entries.where(F.coalesce(moment >= F.lit(since).cast("timestamp"), F.lit(True)))


def pending(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.where(F.col(column).isNull())


def equal(df: DataFrame, filters: dict) -> DataFrame:
    """Rows with these values; None is no condition."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in filters.items() if v is not None], df)


def run_stats(df: DataFrame, raw: str, clean: str) -> DataFrame:
    """items, changed and emptied of a cleaning run."""
    return df.agg(F.count("*").alias("items"), F.count_if(~F.col(raw).eqNullSafe(F.col(clean))).alias("changed"), F.count_if(F.col(raw).isNotNull() & (F.coalesce(clean, F.lit("")) == "")).alias("emptied"))


def gates(stats: DataFrame, least_items: int, most_errors: int) -> DataFrame:
    """stats (items, errors) with whether the run passes, and why not."""
    few, many = F.col("items") < least_items, F.col("errors") > most_errors
    return stats.withColumn("passed", ~few & ~many).withColumn("reason", F.when(few, "pocos_articulos").when(many, "demasiados_errores"))


def load_fields(df: DataFrame, processors: dict) -> DataFrame:
    """Fields through their processors: a name to a function of a column, or to several in turn; absent fields are passed over."""
    chain = lambda c, steps: reduce(lambda x, f: f(x), steps if isinstance(steps, (list, tuple)) else [steps], F.col(c))
    return df.withColumns({c: chain(c, steps) for c, steps in processors.items() if c in df.columns})
