"""Uniform shuffling into shards of exact size, with DataFrame functions only.

Rows lie in logical partitions (blocks) by a digest of their content. A communication matrix says
how many rows of each block go to each shard: under a uniform random permutation of all rows into
shards of fixed sizes, these counts follow the multivariate hypergeometric law. They are drawn by
halving: the blocks of a range are split in two, the left half's counts are drawn given the
range's counts, the right half keeps the rest, level by level, every range of a level in parallel.
Then rows permute inside their block, go to shards by rank, and permute again inside the shard.

One draw costs the same at any number of rows (ratio of uniforms with a table mountain hat, by
Stadlober), so the matrix depends on blocks and shards only, not on rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import materialize

#: Constants of the ratio-of-uniforms hat: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
HAT_WIDTH, HAT_SHIFT = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
CANDIDATES = 40


def _log_factorial(n: str) -> str:
    """ln n! in SQL: exact up to 20, above by Stirling's series (error below 1e-12)."""
    return (
        f"(CASE WHEN {n} <= 20 THEN ln(CAST(factorial(CAST({n} AS INT)) AS DOUBLE)) ELSE "
        f"({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046728D + 1D / (12D * {n}) - 1D / (360D * pow({n}, 3)) + 1D / (1260D * pow({n}, 5)) END)"
    )


def _uniform(*parts: str) -> str:
    """A number in (0, 1) from a hash of the parts."""
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) / 9007199254740992D)"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with a name for a value (a lambda over an array of one)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def hypergeometric(good: str, total: str, draws: str, seed: str) -> str:
    """SQL for a draw of how many of `draws` rows, taken from `total`, are among `good`.

    Small cases draw row by row. Else candidates of the ratio-of-uniforms method are tested in
    order and the first accepted one counts (each is accepted with a chance of about 0.7 or more,
    so that all of 40 fail less than once in 10^20; then the mode is taken).
    """
    f = _log_factorial
    few = (
        f"aggregate(sequence(1L, {draws}), 0L, (got, i) -> got + CASE WHEN {_uniform(seed, 'i')} * "
        f"({total} - i + 1L) < {good} - got THEN 1L ELSE 0L END)"
    )
    # p: k of the rarer kind, l of the other, m the smaller of the draws and what they leave, t all
    parts = (
        f"struct(least({good}, {total} - {good}) AS k, greatest({good}, {total} - {good}) AS l, "
        f"least({draws}, {total} - {draws}) AS m, {total} AS t, CAST(least({good}, {total} - {good}) AS DOUBLE) / {total} AS share)"
    )
    shape = (
        "struct(p.m * p.share AS mean, sqrt((p.t - p.m) * CAST(p.m AS DOUBLE) * p.share * (1D - p.share) / (p.t - 1D) + 0.5D) AS sd, "
        "CAST(floor((p.m + 1D) * (p.k + 1D) / (p.t + 2D)) AS BIGINT) AS mode)"
    )
    weight = lambda z: f"({f(z)} + {f(f'(p.k - {z})')} + {f(f'(p.m - {z})')} + {f(f'(p.l - p.m + {z})')})"
    pair = f"struct({_uniform(seed, 'i', '1')} AS x, {_uniform(seed, 'i', '2')} AS y)"
    value = f"p.m * p.share + 0.5D + ({HAT_WIDTH}D * q.sd + {HAT_SHIFT}D) * (c.y - 0.5D) / c.x"
    candidate = _let("c", pair, f"struct(c.x AS x, {value} AS w)")
    test = (
        "v.w >= 0 AND v.w < least(CAST(least(p.m, p.k) AS DOUBLE) + 1D, floor(q.mean + 0.5D + 16D * q.sd)) AND "
        + _let("z", "CAST(floor(v.w) AS BIGINT)", f"2D * ln(v.x) <= peak - {weight('z')}")
    )
    first = f"element_at(filter(transform(sequence(1, {CANDIDATES}), i -> {candidate}), v -> {test}), 1).w"
    rarer = _let("p", parts, _let("q", shape, _let("peak", weight("q.mode"), f"coalesce(CAST(floor({first}) AS BIGINT), q.mode)")))
    # from the rarer kind and the smaller draw back to what was asked for
    asked = _let(
        "z",
        rarer,
        _let(
            "of_good",
            f"CASE WHEN {good} > {total} - {good} THEN least({draws}, {total} - {draws}) - z ELSE z END",
            f"CASE WHEN {draws} > {total} - {draws} THEN {good} - of_good ELSE of_good END",
        ),
    )
    return (
        f"CASE WHEN {good} <= 0 OR {draws} <= 0 THEN 0L WHEN {good} >= {total} THEN {draws} WHEN {draws} >= {total} THEN {good} "
        f"WHEN {draws} <= 20 THEN {few} ELSE {asked} END"
    )


def communication_matrix(block_sizes: DataFrame, shard_sizes: list[int], blocks: int, seed: int = 0) -> DataFrame:
    """(block, counts array<long> by shard), one row for each of `blocks` blocks, a power of two.

    block_sizes: (block, n). Row sums are the blocks' sizes, column sums exactly shard_sizes.
    Ranges without rows get zeros. Each level draws, shard after shard, from what is left.
    """
    spark = block_sizes.sparkSession
    levels = blocks.bit_length() - 1
    matrix = spark.createDataFrame([(0, [int(n) for n in shard_sizes])], "node long, counts array<long>")
    for level in range(1, levels + 1):
        draw = hypergeometric("c", "s.total", "s.need", f"{seed}, {level}, node, size(s.got)")
        shift = levels - level + 1
        left = (
            block_sizes.withColumn("node", F.shiftright("block", shift))
            .groupBy("node")
            .agg(F.sum(F.when(F.shiftright("block", shift - 1) % 2 == 0, F.col("n")).otherwise(0)).alias("n_left"))
        )
        drawn = matrix.join(left, "node", "left").withColumn("n_left", F.coalesce("n_left", F.lit(0).cast("long"))).withColumn(
            "left_counts",
            F.expr(
                "aggregate(counts, struct(aggregate(counts, 0L, (a, b) -> a + b) AS total, n_left AS need, CAST(array() AS array<bigint>) AS got), "
                f"(s, c) -> element_at(transform(array({draw}), d -> struct(s.total - c AS total, s.need - d AS need, concat(s.got, array(d)) AS got)), 1), s -> s.got)"
            ),
        )
        matrix = drawn.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left_counts").alias("counts")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(counts, left_counts, (a, b) -> a - b)").alias("counts")),
                )
            ).alias("half")
        ).select("half.*")
        if level % 3 == 0 and level < levels:
            matrix = materialize(matrix, "shard-matrix")
    return matrix.withColumnRenamed("node", "block")


def _running(counts: str) -> str:
    """SQL for the running sums of an array."""
    return f"transform(sequence(1, size({counts})), i -> aggregate(slice({counts}, 1, i), 0L, (a, b) -> a + b))"


def shard_rows(keyed: DataFrame, n_shards: int = 16, rows_per_block: int = 250_000, min_blocks: int = 64, max_blocks: int = 65_536, seed: int = 0) -> DataFrame:
    """Add `shard` and `slot` to rows that have a column `digest` (a hash of their content).

    Shard sizes differ by one at most. Blocks hold about rows_per_block rows each, and at least
    min_blocks of them spread the local permutations. keyed is read several times, so it should be
    a table. Slots are gapless from 0 in each shard: a shard is cut into as many random cells as
    there are blocks per shard, rows are ranked inside a cell, and cells are laid end to end; thus
    no task holds a shard. Rows with one digest are interchangeable.
    """
    n = keyed.count()
    blocks = min_blocks
    while blocks < max_blocks and blocks * rows_per_block < n:
        blocks *= 2
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    cells = max(4, 4 * blocks // n_shards)
    rows = keyed.withColumn("block", F.pmod(F.col("digest"), F.lit(blocks)))
    counted = materialize(rows.groupBy("block").agg(F.count("*").alias("n")), "shard-blocks")
    matrix = communication_matrix(counted, sizes, blocks, seed).filter("exists(counts, c -> c > 0)")
    matrix = materialize(matrix.select("block", F.expr(_running("counts")).alias("upto")), "shard-matrix")
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "digest"))
    ranked = rows.withColumn("rank", F.row_number().over(local) - 1).join(matrix, "block")
    shard = F.expr("size(filter(upto, u -> u <= rank))")
    placed = ranked.select(*[c for c in keyed.columns], shard.alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit(2), "digest"), F.lit(cells)).alias("cell"))
    placed = materialize(placed, "shard-placed")
    per_cell = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_cell.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    again = Window.partitionBy("shard", "cell").orderBy(F.xxhash64(F.lit(seed), F.lit(3), "digest"))
    inside = placed.withColumn("place", F.row_number().over(again) - 1)
    return inside.join(starts, ["shard", "cell"]).select(*[c for c in keyed.columns], "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document under the law `rows`.

    Null text has no bytes: size 1, crc 0. An empty table gives no rows. Repeated rows get places
    of their own; the digest holds a row's number in its input, so that a row that is repeated very often is spread like any
    others. Very long texts are only hashed. Other columns are ignored.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("digest"),
    )
    return shard_rows(materialize(keyed, "shard-keys"), n_shards, seed=seed).drop("digest")
