"""Near-duplicates by MinHash: banded minima, verification, components by alternating stars.

Exact copies collapse first (equal digests of the shingle sets). Each distinct set has 300 minima of universal
hashes over its shingles, in 50 bands of 6 rows: two sets with a similarity of 0.8 miss all bands with a
chance of 3 in 10^7. No bucket is expanded into pairs. Instead:

1. Every member of a bucket is compared with the bucket's smallest id only; links give components.
2. A bucket whose members are all in one component can't change anything more. In each of the others,
   members outside its most frequent component are compared with the members of other components. A bucket in
   which many unlinked sets look alike is dealt to a grid of cells, some 2000 members on either side of each, so that no
   task meets a whole bucket; all cells together are spread over as many tasks as the counted comparisons need.

Before full sets are compared, a pair has to pass a bound on the verification signature: 2048 parity bits,
each the parity of the number of shingles hashed to it. The bits in which two signatures differ are at most
as many as the shingles in which the sets differ, so the bound never loses a link, yet drops nearly all
pairs that are not linked. It's part of the join's condition, so that such pairs are never emitted. What
passes is confirmed on full sets.

Components: large-star and small-star alternate until the edges do not change.

Defined results: null text, or text without words, has no set, is linked with nothing and stays; fewer words than
a shingle has are one shingle; documents with one doc_id are one node; rows with a null doc_id are linked with
nothing, have no component and stay; an empty table gives no rows; a very long text is hashed in blocks, to its end; doc_id keeps
its type, and the smallest one in its order names a component; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import discard, materialize
from .text import bodies, mix, shingles, slices, words

ROWS, BANDS = 6, 50
PARITY_WORDS = 32
PARITY = [f"p{i}" for i in range(PARITY_WORDS)]
#: Members of a bucket on either side of a cell of comparisons, and comparisons for each task.
CELL, COMPARISONS = 2000, 20_000_000


@functools.lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the universal hashes h(x) = a x + b modulo 2^32."""
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.int64) * 2 + 1
    b = rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.int64)
    return a.astype(np.uint32), b.astype(np.uint32)


def minima(items: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over the items."""
    a, b = _family()
    x = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    work = np.empty((256, len(a)), np.uint32)
    for at in range(0, len(x), 256):
        part = x[at : at + 256, None]
        out = work[: len(part)]
        np.multiply(part, a, out=out)
        np.add(out, b, out=out)
        np.minimum(low, np.minimum.reduce(out, axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of minima."""
    m = low.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, r])
    return h.view(np.int64)


def parity(items: np.ndarray) -> np.ndarray:
    """2048 bits: of each, whether an odd number of items is hashed to it."""
    counts = np.bincount((items & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, bands, parity and two digests of every row."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in (x for whole in batches for x in slices(whole, 1)):
            n, bands, bits, seen = [], [], [], []
            for body in bodies(batch.column(1)):
                hashes = words((body or b"").lower())[0]
                items = shingles(hashes, k)
                n.append(len(items))
                # two sums over the set: equal sets have equal digests
                seen.append((items.sum(dtype=np.uint64), mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                bands.append(band_keys(minima(items)) if len(items) else None)
                bits.append(parity(items) if len(items) else None)
            digests = np.array(seen, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(bands, longs), pa.array(bits, longs), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "bands", "parity", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(
        signed, f"doc_id {_kind(docs)}, n_shingles long, bands array<long>, parity array<long>, d1 long, d2 long"
    )


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, items): the full shingle sets of the rows of docs."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, 1)):
            items = [shingles(words((body or b"").lower())[0], k).view(np.int64) for body in bodies(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], ["id", "items"])

    return docs.select("doc_id", "text").mapInArrow(full, f"id {_kind(docs)}, items array<long>")


def _similar(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def _side(members: DataFrame, name: str, *more: str) -> DataFrame:
    """members with their columns named for one side of a pair; parities are plain columns, which a join reads without unpacking."""
    return members.select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "n", *more, *PARITY)])


def _possible(percent: int) -> Column:
    """Whether the pair (a, b) can be similar: by the sets' sizes, then by the bits in which parities differ.

    Sets that differ in d items of s = |a| + |b| have the similarity (s - d) / (s + d). Half of the bits are often enough to say no.
    """
    n_a, n_b = F.col("a_n"), F.col("b_n")
    bits = [F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITY]
    half = functools.reduce(operator.add, bits[: PARITY_WORDS // 2])
    few = lambda differ: (100 + percent) * differ <= (100 - percent) * (n_a + n_b)
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & few(half) & few(functools.reduce(operator.add, bits))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(_similar(common, F.size("items_a"), F.size("items_b"), percent)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (a, b): component is its smallest reachable node.

    Large-star links each node's larger neighbours to the smallest node around; small-star links its smaller
    neighbours and itself to it. Each is a partial minimum per node and a join, never a list of neighbours. The minima
    are tables of their own, so that the join's other side, in which a hub has many rows, can be split. When a round leaves the edges
    as they were, they are stars around the components. Each round's tables are deleted when the next one's are written.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "star")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        discard(before, least, large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members with the component of each id: its own id where it has no link."""
    groups = groups.withColumnRenamed("id", "node")
    return members.join(groups, members["id"] == groups["node"], "left").withColumn("component", F.coalesce("component", "id")).drop("node")


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    signed = materialize(_signatures(docs, k), "minhash")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    first = signed.filter(own).groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    first = materialize(first, "minhash-first")
    texts = signed.filter(own).join(first.withColumnRenamed("id", "doc_id"), ["d1", "d2", "doc_id"], "left_semi")
    texts = texts.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "parity", "bands")
    texts = materialize(texts, "minhash-texts")

    rows = texts.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader <> last").drop("last")
    members = materialize(rows.join(shared, "bucket"), "minhash-buckets")
    parities = [F.col("parity")[i].alias(p) for i, p in enumerate(PARITY)]
    slim = materialize(texts.select("id", "n", *parities).join(members.select("id").distinct(), "id", "left_semi"), "minhash-parity")

    pairs = members.filter("id <> leader").select(F.col("leader").alias("x"), F.col("id").alias("y")).distinct()
    starred = pairs.join(_side(slim, "a"), F.col("x") == F.col("a_id")).join(_side(slim, "b"), (F.col("y") == F.col("b_id")) & _possible(percent))
    starred = materialize(starred.select(F.col("x").alias("a"), F.col("y").alias("b")), "minhash-pairs")
    # the candidates grow with the documents, so they are never broadcast, however few they are
    candidates = slim.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_merge")
    wanted = docs.select("doc_id", "text").join(candidates, "doc_id", "left_semi")
    sets = materialize(_sets(wanted, k), "minhash-sets")
    links = materialize(_confirmed(starred, sets, percent), "minhash-links")

    groups = components(links)
    held = materialize(_labelled(members.select("bucket", "id"), groups), "minhash-held")
    by_group = held.groupBy("bucket", "component").agg(F.count("*").alias("rows"))
    mixed = by_group.groupBy("bucket").agg(
        F.count("*").alias("groups"), F.sum("rows").alias("rows"), F.max("rows").alias("main_rows"), F.max_by("component", F.struct("rows", "component")).alias("main")
    )
    # the members outside the main component meet all, in a grid of cells
    parts = lambda n: F.ceil(n / F.lit(CELL)).cast("int")
    mixed = mixed.filter("groups > 1").select("bucket", "main", parts(F.col("rows") - F.col("main_rows")).alias("rows_of"), parts(F.col("rows")).alias("columns_of"), ((F.col("rows") - F.col("main_rows")) * F.col("rows")).alias("work"))
    mixed = materialize(mixed, "minhash-mixed")
    open_ = materialize(held.join(mixed.drop("work"), "bucket"), "minhash-open")
    work = mixed.agg(F.sum("work")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(work) // COMPARISONS))
    lot = F.xxhash64("id", "bucket")
    own_row, own_column = F.pmod(lot, F.col("rows_of")).cast("int"), F.pmod(lot, F.col("columns_of")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    few = open_.filter("component <> main").select("id", "bucket", "component", own_row.alias("own"), every("columns_of"))
    few = few.select("id", "component", F.xxhash64("bucket", "own", "other").alias("cell"), "bucket")
    all_ = open_.select("id", "bucket", "component", "main", own_column.alias("own"), every("rows_of"))
    all_ = all_.select("id", "component", "main", F.xxhash64("bucket", "other", "own").alias("cell"), "bucket")
    # a number of tasks of its own, since cells are small in bytes but not in comparisons
    few = _side(few.join(slim, "id"), "a", "component", "cell", "bucket").repartition(tasks, "a_cell", "a_bucket")
    all_ = _side(all_.join(slim, "id"), "b", "component", "main", "cell", "bucket").repartition(tasks, "b_cell", "b_bucket")
    # two members outside the main component meet twice; the smaller id speaks
    once = (F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("b_main")) | (F.col("a_id") < F.col("b_id")))
    met = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_bucket") == F.col("b_bucket"))
    crossed = few.hint("shuffle_merge").join(all_, met & once & _possible(percent))
    crossed = materialize(crossed.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct(), "minhash-crossed")
    more = materialize(_confirmed(crossed, sets, percent), "minhash-more")
    groups = components(links.union(more))
    discard(texts, starred, sets, slim, members, held, mixed, open_, crossed, links, more)

    copies = _labelled(first, groups).select("d1", "d2", "component")
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(copies, ["d1", "d2"], "left")
    component = F.when(own, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.coalesce(component == F.col("doc_id"), F.lit(True))).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, unchanged, without those of a group whose doc_id is not the group's smallest."""
    gone = materialize(classes(docs, k, percent).filter(~F.col("kept")).select("doc_id").distinct(), "minhash-gone")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
