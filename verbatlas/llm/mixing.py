"""Mixing sources to target weights by exponential keys, with DataFrame functions only.

Every source gets a word target from its weight. A target of at least the source's own size is met
by complete epochs; what is left is drawn without replacement by Efraimidis and Spirakis: each
document has the key -ln(u) / q, u uniform from a digest of the document and q its quality, and
documents are taken by rising key until the prefix sum of sizes reaches the budget.

The prefix sum never sorts a source as a whole. Keys are binned on a logarithmic scale; sizes are
summed per source and bin (partial sums on the map side); a window over the bins of a source finds
the one bin in which the budget ends; only that bin's keys are sorted. The result is one cut per
source, and documents compare their key with it, so a source with a third of all rows is no hot task.

Defined results: null or empty text has size 0 and takes 0 words; a null source is a source of its
own, last in order; an empty table gives no rows; rows that are equal in id and text share one key,
and where the budget ends among them each takes an equal whole part (what that leaves, fewer words than such rows, is not taken);
very long texts are only counted; other columns are ignored, or
kept by `mixed`, which replaces none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import materialize, word_count

SYMBOLS = r"[#*$%&|<>]"
BINS_PER_OCTAVE = 1024


def quality(text: Column, size: Column) -> Column:
    """Sampling weight in (0, 1]: the fewer markup symbols per word, the sooner a document is drawn."""
    n = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return (size + 1) / (size + 1 + n)


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest: the same on every run and every executor."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _keyed(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))
    key = -F.log(uniform(F.col("doc_id"), F.col("text"))) / quality(F.col("text"), F.col("size"))
    return sized.select("doc_id", "source", "size", key.alias("draw_key")).withColumn(
        "bin", F.floor(F.log2("draw_key") * BINS_PER_OCTAVE)
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """Word targets from (source, source_size), one row per source.

    Weights repeat over sources in code-point order, null last. Targets share `share` times all
    words by weight; none exceeds `most` times its source, and the excess goes to the others by
    weight until none is above. That fixed point is a level: every source gets the smaller of its
    limit and level * weight. Sorted by limit / weight, the limited sources come first, so prefix
    sums find the level without iteration. The windows run over one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(ordered) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), pos + 1)).withColumn(
        "cap", F.lit(most) * F.col("source_size")
    )
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    found = (
        weighted.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("free_weight", F.sum("weight").over(everything) - F.sum("weight").over(rising))
        .withColumn("full", F.sum("cap").over(rising) + F.col("ratio") * F.col("free_weight") <= F.col("budget"))
        .withColumn("full_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    )
    level = (F.col("budget") - F.col("full_cap")) / F.col("open_weight")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return found.select("source", "source_size", target.alias("target"))


def _cuts(keyed: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: target, complete epochs, and the key where the fractional epoch ends.

    cut_rows rows have that very key and share cut_words words; earlier keys are taken whole.
    """
    words = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    plan = goals.withColumn("epochs", epochs).withColumn("rest", words - F.col("epochs") * F.col("source_size"))
    per_bin = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = per_bin.withColumn("upto", F.sum("bin_size").over(by_bin)).select(
        F.col("source").alias("s"), F.col("bin").alias("cut_bin"), (F.col("upto") - F.col("bin_size")).alias("before"), "upto"
    )
    held = plan.join(
        ends,
        plan["source"].eqNullSafe(ends["s"]) & (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("upto")),
        "left",
    ).drop("s", "upto")
    held = materialize(held, "mix-bins")
    inside = keyed.select(F.col("source").alias("s"), "bin", "draw_key", "size")
    inside = (
        inside.join(held, inside["s"].eqNullSafe(held["source"]) & (F.col("bin") == F.col("cut_bin")))
        .groupBy("s", "draw_key")
        .agg(F.sum("size").alias("words"), F.count("*").alias("cut_rows"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    by_key = Window.partitionBy("s").orderBy("draw_key").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        inside.withColumn("upto", F.col("before") + F.sum("words").over(by_key))
        .filter((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
        .select("s", F.col("draw_key").alias("cut_key"), "cut_rows", (F.col("rest") - F.col("upto") + F.col("words")).alias("cut_words"), F.col("words").alias("cut_size"))
    )
    out = held.join(cut, held["source"].eqNullSafe(cut["s"]), "left")
    return materialize(out.select("source", "source_size", "target", "epochs", "cut_key", "cut_rows", "cut_words", "cut_size"), "mix-cuts")


def _with_cuts(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    cuts = cuts.withColumnRenamed("source", "cut_source")
    return keyed.join(cuts, keyed["source"].eqNullSafe(cuts["cut_source"]), "left")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mix takes of each document.

    A document on which the budget ends gives its first words only, so a source's taken words add
    up to its rounded target.
    """
    keyed = materialize(_keyed(docs), "mix-keys")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    joined = _with_cuts(keyed, _cuts(keyed, targets(sizes, weights, share, most)))
    part = (
        F.when(F.col("draw_key") < F.col("cut_key"), F.col("size"))
        .when(F.col("draw_key") == F.col("cut_key"), F.least("size", F.floor(F.col("cut_words") / F.col("cut_rows"))))
        .otherwise(0)
    )
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mixed documents themselves, each row as often as it is taken, with all columns of docs.

    Texts stay whole: the document on which a budget ends is taken if at least half of it fits.
    The key is recomputed on the full rows, so no join on doc_id is needed and repeated rows stay apart.
    """
    keyed = materialize(_keyed(docs), "mix-keys")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = _cuts(keyed, targets(sizes, weights, share, most))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    row = row.withColumn("size", word_count(F.col("text")))
    row = row.select("row", "source", "size", (-F.log(uniform(F.col("doc_id"), F.col("text"))) / quality(F.col("text"), F.col("size"))).alias("draw_key"))
    joined = _with_cuts(row, cuts)
    extra = (F.col("draw_key") < F.col("cut_key")) | ((F.col("draw_key") == F.col("cut_key")) & (2 * F.col("cut_words") >= F.col("cut_size")))
    times = F.col("epochs") + F.coalesce(extra.cast("long"), F.lit(0))
    copies = F.explode(F.array_repeat(F.lit(0), times.cast("int")))
    return joined.select("row", copies.alias("copy")).select("row.*")
