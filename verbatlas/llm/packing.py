"""Best-fit packing planned over a histogram of lengths.

Documents are tokenized, closed by an end id and cut into pieces of at most one sequence. The
pieces' lengths are counted; as there are at most `capacity` lengths, the plan is made on the driver from
counts alone: best fit by falling length, a whole group of equal gaps at a time. It says for each
length and range of ranks which sequences and offsets the pieces get. Pieces are then ranked within
their length and take the planned slots by a join on length and cell. Ranks are made per cell of a
length (a hash of the document and its row) and the cells' counts summed up, so that no task ranks a whole length,
not even if one document is repeated very often.

Defined results: null or empty text is one piece that holds the end id; a very long text is tokenized in blocks and gives many
pieces; an empty table gives no rows; repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _schema(docs: DataFrame, spec: str) -> str:
    """The spec with the type that doc_id has in docs."""
    return spec.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def tokenized(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and the ids as bytes if asked."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text import bodies, slices
        from .tokens import encoder

        encode, end = encoder(path).ids_of, end_id.to_bytes(4, "little")
        width = 4 * capacity
        for part in (x for batch in batches for x in slices(batch, 1)):
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            texts = encode([body or b"" for body in bodies(part.column(1))])
            for doc_id, ids in zip(part.column(0).to_pylist(), texts, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    cut = ids[at : at + width]
                    for into, x in zip(rows, (doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut), cut)):
                        into.append(x)
            kinds = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(rows)])

    return docs.select("doc_id", "text").mapInArrow(pieces, _schema(docs, PIECE + ", ids binary" * with_ids))


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, first rank, first sequence, pieces per sequence, offset).

    Pieces of a length with ranks from `first rank` to the next row's fill sequences in order,
    `pieces per sequence` at a time, side by side from `offset`. Lengths fall; each takes the smallest gaps
    that hold it. A sequence that took a piece has the smallest gap that fits until it's too small,
    so groups of equal gaps take all they can at once.
    """
    gaps: list[int] = []  # the sizes of open gaps, sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # for each, runs of sequences: first, count
    plan, new = [], 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in open_:
                insort(gaps, gap)
            open_.setdefault(gap, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, count = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            else:
                gap, first = capacity, new
                count = -(-left // (capacity // length))
                new += count
            each = gap // length
            whole, some = min(count, left // each), 0
            if whole < count:
                some = left - whole * each
            plan.append((length, rank, first, each, capacity - gap))
            leave(gap - each * length, first, whole)
            if some:
                leave(gap - some * length, first + whole, 1)
            leave(gap, first + whole + bool(some), count - whole - bool(some))
            rank += whole * each + some
            left -= whole * each + some
    return plan


def pack(pieces: DataFrame, capacity: int = 4096, min_cells: int = 64, rows_per_cell: int = 100_000) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (doc_id, piece, length and any others).

    The driver sees one row per length. The plan has at most a few rows per length and open gap, so its size is
    bounded by the capacity, not by the documents. pieces is read several times, so it should be a table. A
    length has as many cells as the most frequent one needs to hold about rows_per_cell rows in each; a cell carries the
    plan's rows that its ranks touch, one or two in most. If pieces has a column `lot`, cells are dealt by it, else by doc_id and piece.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    cells = max(min_cells, -(-max(histogram.values(), default=0) // rows_per_cell))
    lot = F.col("lot") if "lot" in pieces.columns else F.xxhash64("doc_id", "piece")
    celled = pieces.withColumn("cell", F.pmod(lot, F.lit(cells))).drop("lot")
    counts = materialize(celled.groupBy("length", "cell").agg(F.count("*").alias("n")), "pack-lengths")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("cell_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # (length, ranks from..to, first sequence, pieces side by side, offset)
    rows, planned = plan_slots(histogram, capacity), []
    for k, (length, rank, *slot) in enumerate(rows):
        following = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == length else histogram[length]
        planned.append((length, rank, following - 1, *slot))
    plan = spark.createDataFrame(planned, "of long, rank long, last long, first long, each long, offset long")
    touched = (F.col("length") == F.col("of")) & (F.col("rank") < F.col("cell_start") + F.col("n")) & (F.col("last") >= F.col("cell_start"))
    slots = starts.join(plan, touched).groupBy("length", "cell", "cell_start").agg(F.array_sort(F.collect_list(F.struct("rank", "first", "each", "offset"))).alias("slots"))
    slots = materialize(slots, "pack-plan")
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    ranked = celled.withColumn("place", F.row_number().over(order) - 1).join(slots, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("cell_start") + F.col("place"))
    taken = ranked.withColumn("slot", F.expr("element_at(filter(slots, s -> s.rank <= rank), -1)")).withColumn("nth", F.col("rank") - F.col("slot.rank"))
    return taken.select(
        *[c for c in pieces.columns if c != "lot"],
        (F.col("slot.first") + F.floor(F.col("nth") / F.col("slot.each"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + F.pmod("nth", "slot.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    lot = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()).alias("lot")
    return pack(materialize(tokenized(docs, path, capacity, end_id).select("*", lot), "pack-pieces"), capacity)
