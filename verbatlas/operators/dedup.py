"""Duplicate rows and groups, and resolution of entities from two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups(df: DataFrame, by: str, key: str) -> DataFrame:
    """Values that belong to more than one key: value, keys, first."""
    return df.groupBy(by).agg(F.countDistinct(key).alias("keys"), F.min(key).alias("first")).filter("keys > 1")


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    """How many groups of two or more rows there are, and how many rows they hold."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("rows")).filter("rows > 1")
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def surplus(df: DataFrame, parent: str, value: str) -> DataFrame:
    """All rows less the distinct texts parent-value; a null parent makes no text, a null value an empty one."""
    text = F.concat(F.col(parent).cast("string"), F.lit("-"), F.coalesce(F.col(value), F.lit("")))
    return df.agg((F.count("*") - F.countDistinct(text)).alias("surplus"))


def deduplicated(df: DataFrame, parent: str, value: str, key: str) -> DataFrame:
    """Of rows with equal parent and value the one with the smallest key; rows with a null parent all stay."""
    first = df.filter(F.col(parent).isNotNull()).groupBy(parent, value).agg(F.min(key).alias(key))
    return df.filter(F.col(parent).isNull()).unionByName(df.filter(F.col(parent).isNotNull()).join(first.select(key), key, "left_semi"))


def matched(left: DataFrame, right: DataFrame, name: str, kind: str, key: str) -> DataFrame:
    """name, left_id, right_id, outcome for names on both sides.

    One row on each side and the same kind: merge. One each, but kinds differ: pos_mismatch. Else ambiguous.
    Each side is summed up by name before they meet.
    """
    side = lambda df, s: df.groupBy(name).agg(F.count("*").alias(f"{s}_rows"), F.min(key).alias(f"{s}_id"), F.min(kind).alias(f"{s}_kind"))
    both = side(left, "left").join(side(right, "right"), name)
    single = (F.col("left_rows") == 1) & (F.col("right_rows") == 1)
    outcome = F.when(~single, "ambiguous").when(F.col("left_kind").eqNullSafe(F.col("right_kind")), "merge").otherwise("pos_mismatch")
    return both.select(name, "left_id", "right_id", outcome.alias("outcome"))


def unique_slugs(df: DataFrame, base: str, key: str) -> DataFrame:
    """key, slug: the base for the first row, then base-2, base-3 and so on by key."""
    place = Window.partitionBy(base).orderBy(key)
    n = F.row_number().over(place)
    return df.select(key, F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))).alias("slug"))


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old_value, new_value for every field that differs, null-safe, as text."""
    a = before.select(key, *[F.col(f).cast("string").alias(f"old_{f}") for f in fields])
    b = after.select(key, *[F.col(f).cast("string").alias(f"new_{f}") for f in fields])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"), F.col(f"new_{f}").alias("new_value")) for f in fields]))
    return a.join(b, key).select(key, rows.alias("c")).select(key, "c.*").filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def merged(targets: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows that stay after a merge: a field of updates where it has one, else the target's own. Updates are one per key."""
    new = updates.select(F.col(key).alias("own_key"), *[F.col(f).alias(f"new_{f}") for f in fields])
    rows = targets.join(new, targets[key] == new["own_key"], "left")
    return rows.select(key, *[F.coalesce(f"new_{f}", f).alias(f) for f in fields])


def merge_audit(targets: DataFrame, after: DataFrame, sources: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old_value, new_value: the changed fields, and one row `mergedFrom` for each merged row of sources (key, source)."""
    origin = sources.select(key, F.lit("mergedFrom").alias("field"), F.lit(None).cast("string").alias("old_value"), F.col("source").cast("string").alias("new_value"))
    return field_changes(targets, after, key, fields).unionByName(origin)


def without_ids(lists: DataFrame, gone: DataFrame, key: str, ids: str) -> DataFrame:
    """lists (key, an array of ids) without ids that are gone (gone: id), in their order; a list that loses its last id goes.

    Ids become rows and meet those that are gone in one join, so neither side has to be small.
    """
    rows = lists.select(key, F.posexplode(ids).alias("at", "id")).join(gone.select("id").distinct(), "id", "left_anti")
    kept = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("kept"))
    kind = lists.schema[ids].dataType.simpleString()
    own = lists.join(kept.withColumnRenamed(key, "own_key"), F.col(key) == F.col("own_key"), "left").filter(F.col("kept").isNotNull() | (F.size(ids) == 0))
    return own.select(key, F.coalesce(F.col("kept.id"), F.array().cast(kind)).alias(ids))
