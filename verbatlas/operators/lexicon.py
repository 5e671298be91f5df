"""Search, joins and reports over relational lexicon tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import falling, numbered, rising


def has(column: Column, text: str) -> Column:
    """Contains, without regard to case; no character of the text is a wildcard."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def any_has(columns: list[Column], text: str) -> Column:
    return reduce(lambda a, b: a | b, [has(c, text) for c in columns])


def all_equal(present: dict[str, object]) -> Column:
    """AND over the parameters that are given; true without any."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in present.items() if v is not None], F.lit(True))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Rows of a page, numbered from 1. The order has to end in a unique key."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def trigrams(column: Column) -> Column:
    """Distinct lower-case runs of three characters."""
    low = F.lower(column)
    n = F.length(low) - 2
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array())


def trigram_index(df: DataFrame, key: str, column: str) -> DataFrame:
    """(trigram, key): an inverted index to be written once and probed by queries of three characters or more."""
    return df.select(key, F.explode(trigrams(F.col(column))).alias("trigram")).select("trigram", key)


def search_index(df: DataFrame, index: DataFrame, key: str, column: str, text: str) -> DataFrame:
    """Rows that contain the text, found by the index: rows with all of its trigrams, then confirmed."""
    low = text.lower()
    wanted = {low[i : i + 3] for i in range(len(low) - 2)}
    if not wanted:
        return df.filter(has(F.col(column), text))
    hits = index.filter(F.col("trigram").isin(*wanted)).groupBy(key).agg(F.count("*").alias("found")).filter(F.col("found") == len(wanted))
    return df.join(hits.select(key), key, "left_semi").filter(has(F.col(column), text))


def own_or_child(df: DataFrame, child: DataFrame, key: str, own: Column, of_child: Column) -> DataFrame:
    """Rows that fit a condition of their own, or have a row in the child table that fits another one."""
    by_child = child.filter(of_child).select(key).distinct().withColumn("by_child", F.lit(True))
    return df.join(by_child, key, "left").filter(own | F.col("by_child").isNotNull()).select(*df.columns)


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Left rows with the columns of their first right row in the order, null without one: a minimum per key, then a join."""
    first = right.groupBy(key).agg(F.min(F.struct(*order, *columns)).alias("first"))
    return left.join(first, key, "left").select(left["*"], *[F.col(f"first.{c}") for c in columns])


def duplicates(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """Add dup_count (rows with an equal value, 1 for null) and any_flag over them.

    Groups are summed up by value on the map side and joined back, so that equal values need not meet in one task.
    """
    groups = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("dup_count"), F.max(flag).alias("any_flag"))
    out = df.join(groups, value, "left")
    return out.select(df["*"], F.coalesce("dup_count", F.lit(1)).alias("dup_count"), F.coalesce("any_flag", flag).alias("any_flag"))


def duplicate_members(df: DataFrame, value: str, key: str) -> DataFrame:
    """(value, key) of all rows whose value another row has, too: the ids beside a row's own are those of its value."""
    repeated = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("rows")).filter("rows > 1")
    return df.select(value, key).join(repeated.select(value), value, "left_semi")


def placed(rows: DataFrame, first: str, amount: str, key: str) -> DataFrame:
    """Add the 1-based place by rising first, falling amount, then rising key, nulls last."""
    return numbered(rows, [rising(first), falling(amount), rising(key)])


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows per group in each task before it shuffles."""
    place = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows with the values of new rows of the same key, and new rows beside; null values do not overwrite."""
    s, n = stored.alias("s"), new.alias("n")
    columns = [F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in stored.columns]
    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def insert_ignore(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows, and those new ones whose key is not stored."""
    return stored.unionByName(new.join(stored, key, "left_anti"))


def compact(number: Column) -> Column:
    """1.23K, 4.56M, 7.89B; whole below a thousand."""
    form = lambda by, mark: F.concat(F.format_string("%.2f", F.floor(number / by * 100 + 0.5) / 100), F.lit(mark))
    return (
        F.when(number >= 1e9, form(1e9, "B"))
        .when(number >= 1e6, form(1e6, "M"))
        .when(number >= 1e3, form(1e3, "K"))
        .otherwise(F.floor(number).cast("string"))
    )


def shortened(value: Column, most: int = 80) -> Column:
    """At most so many characters, then an ellipsis."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("…"))).otherwise(value)
