"""A stored trigram index of texts that follows changes, and exact substring search by it alone.

Texts are cut into segments: the lower-cased texts of about SLICE characters, one after the other. A stored row holds the places in a segment at which a
trigram stands, as differences: their low bytes in one column, what is above in another. The row of a segment's first trigram lists its texts, too: their keys, and where each
starts and ends. The index is a folder: `base-n` holds rows in pieces, each the rows of some tasks, every file of which is sorted by trigram, so that a probe reads few
pages of it; `delta-m` holds the rows of change m, and the keys that it names. Nothing is shuffled to write them. A base covers all changes up to its
number. Texts of a key count unless a later change names the key. Folders without Spark's mark of success count as absent, so a writer that
fails leaves nothing behind that a reader sees, and a change may be applied again under its number. `schema` holds the columns of a row, and no rows.

A new base is made piece by piece, and a piece of the old one goes as soon as the new one is complete, so that the index is stored once and a piece, not
twice. A compaction that fails is taken up by the next one; readers see the newest complete form of each piece. A search that began before and still has to read
a piece that is gone fails for want of the file, and is to be repeated.

A text of three characters or more is found from places alone: its trigrams at the offsets 0, 3, 6 and so on, and at its end, have to
stand at one start. Texts are never read. Searches of fewer characters aren't answered by the index.

Null texts and texts of under three characters have no places. Keys are unique; a changed row is given with its old and its new text, either
may be null (an insert, a deletion).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.sources.tables import slices

#: Characters of a segment; a longer text is a segment of its own.
SLICE = 2_000_000
#: A base has so many pieces at least, and one for so many tasks.
PIECES, TASKS = 8, 64


def _stored_type(kind: str) -> str:
    return f"trigram string, segment long, low binary, high binary, keys array<{kind}>, starts array<int>, ends array<int>"


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value between each two bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of binary values, and their bytes."""
    bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return bounds - bounds[0], np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)


def _coded(places: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Low bytes of the differences of ascending places between bounds, and what is above in groups of seven bits, of which all but the last are marked."""
    gaps = np.diff(places, prepend=0)
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    gaps[first] = places[first]
    above = gaps >> 8
    ends = np.concatenate([[0], np.cumsum(1 + (above >> 7 > 0) + (above >> 14 > 0) + (above >> 21 > 0))])
    groups, left, at = np.empty(ends[-1], np.uint8), above, ends[:-1]
    while len(left):
        groups[at] = left & 127 | (left > 127) << 7
        more = np.flatnonzero(left > 127)
        left, at = left[more] >> 7, at[more] + 1
    return [_binary(gaps & 255, bounds), _binary(groups, ends[bounds])]


def _places(low: pa.Array, high: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and places of such rows."""
    (bounds, gaps), (_, groups) = _bytes(low), _bytes(high)
    if not len(gaps):
        return bounds, np.zeros(0, np.int64)
    last = groups < 128
    at = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    above, value, shift = np.zeros(len(gaps), np.int64), np.arange(len(gaps)), 0
    while len(at):
        above[value] |= (groups[at] & 127).astype(np.int64) << shift
        more = np.flatnonzero(~last[at])
        at, value, shift = at[more] + 1, value[more], shift + 7
    sums = np.concatenate([[0], np.cumsum(above << 8 | gaps)])
    return bounds, sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds))


def _segment(keys: pa.Array, texts: list[str], number: int) -> pa.RecordBatch:
    """The rows of a segment: its characters are numbered, and one sort of trigram and place puts both in order."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    rank = np.zeros(0x110000, np.int64)
    rank[points] = 1
    letters = np.flatnonzero(rank)
    n, rank[letters] = len(letters), np.arange(len(letters))
    inside = np.ones(len(points), bool)
    inside[np.concatenate([ends - 2, ends - 1])] = False
    place, rank = np.flatnonzero(inside), rank[points]
    code = (rank[place] * n + rank[place + 1]) * n + rank[place + 2]
    bits = len(points).bit_length()
    if n**3 << bits < 1 << 63:
        both = np.sort(code << bits | place)
        code, place = both >> bits, both & (1 << bits) - 1
    else:
        order = np.argsort(code, kind="stable")
        code, place = code[order], place[order]
    bounds = np.append(np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])), len(code))
    code = code[bounds[:-1]]
    text = letters[np.stack([code // n // n, code // n % n, code % n], 1)].astype(np.uint32).tobytes().decode("utf-32-le")
    starts = np.concatenate([[0], ends[:-1]])
    once = lambda values: pa.ListArray.from_arrays(pa.array([0, *[len(values)] * len(code)], pa.int32()), values, mask=pa.array(np.arange(len(code)) > 0))
    columns = [pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()), pa.array(np.full(len(code), number)), *_coded(place, bounds)]
    lists = [keys, pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, *map(once, lists)], ["trigram", "segment", "low", "high", "keys", "starts", "ends"])


def stored(rows: DataFrame, key: str, column: str, number: int = 0) -> DataFrame:
    """The stored rows of texts, with the number of the task as `task`; segments have numbers that no other change gives. Nothing is shuffled."""
    low = rows.select(F.col(key).alias("key"), F.lower(column).alias("low")).filter(F.length("low") >= 3)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def segment(keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
            batch = _segment(keys, texts, number << 44 | task << 20 | made)
            return batch.append_column("task", pa.array(np.full(batch.num_rows, task, np.int32)))

        for batch in batches:
            column, first, size, texts = batch.column(1), 0, 0, []
            for i in range(batch.num_rows):
                text = column[i].as_py()
                if texts and size + len(text) > SLICE:
                    yield segment(batch.column(0).slice(first, len(texts)), texts)
                    first, size, texts, made = i, 0, [], made + 1
                texts.append(text)
                size += len(text)
            if texts:
                yield segment(batch.column(0).slice(first, len(texts)), texts)
                made += 1

    return low.mapInArrow(cut, _stored_type(low.schema["key"].dataType.simpleString()) + ", task int")


def _listed(rows: DataFrame) -> DataFrame:
    """(segment, key, start, end): the texts of stored rows."""
    texts = rows.filter("keys IS NOT NULL AND trigram <> ''").select("segment", F.explode(F.arrays_zip("keys", "starts", "ends")).alias("t"))
    return texts.select("segment", F.col("t.keys").alias("key"), F.col("t.starts").alias("start"), F.col("t.ends").alias("end"))


def _of_texts(places: DataFrame, texts: DataFrame, made: Callable[[pa.Table, pa.Array, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What `made` gives of each segment's stored rows and of its texts in order: keys, starts, ends."""

    def of(rows: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("start").combine_chunks()
        if not (rows.num_rows and own.num_rows):
            return pa.table(made(rows.slice(0, 0), own.column("key").combine_chunks().slice(0, 0), np.zeros(0, np.int64), np.zeros(0, np.int64)))
        return made(rows.combine_chunks(), own.column("key").combine_chunks(), own.column("start").to_numpy().astype(np.int64), own.column("end").to_numpy().astype(np.int64))

    rows = places.select("segment", "trigram", "low", "high")
    return rows.groupBy("segment").cogroup(texts.groupBy("segment")).applyInArrow(of, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _opened(places: DataFrame, texts: DataFrame) -> DataFrame:
    """(trigram, postings): of each stored row the keys of its texts, and where in each the trigram stands."""
    kind = texts.schema["key"].dataType.simpleString()

    def made(rows: pa.Table, keys: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        bounds, place = _places(_one(rows.column("low")), _one(rows.column("high"))) if rows.num_rows else (np.zeros(1, np.int64), np.zeros(0, np.int64))
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        owner = np.searchsorted(starts, place, side="right") - 1
        live = (owner >= 0) & (place < ends[owner]) if len(ends) else np.zeros(len(place), bool)
        row, owner, place = row[live], owner[live], place[live]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])])) if len(row) else np.zeros(0, np.int64)
        positions = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array((place - starts[owner]).astype(np.int32) if len(row) else np.zeros(0, np.int32)))
        postings = pa.StructArray.from_arrays([keys.take(pa.array(owner[new])), positions], ["key", "positions"])
        used, first = np.unique(row[new], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(new)), pa.int32()), postings)
        return pa.table({"trigram": rows.column("trigram").take(pa.array(used, pa.int64())), "postings": lists})

    return _of_texts(places, texts, made, f"trigram string, postings array<struct<key: {kind}, positions: array<int>>>")


def blocks(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(trigram, postings): the postings of segments of rows, a row for each trigram of a segment."""
    made = stored(rows, key, column)
    return _opened(made, _listed(made))


def _write(df: DataFrame, path: str, *by: str) -> None:
    """Every file sorted by trigram; row groups are small, so that several tasks may read a file."""
    kept = df.sortWithinPartitions(*by, "trigram", "segment").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20)
    (kept.partitionBy(*by) if by else kept).parquet(path)


def build(rows: DataFrame, key: str, column: str, path: str) -> None:
    """Write the index of all rows."""
    made = stored(rows, key, column)
    spark = rows.sparkSession
    spark.createDataFrame([], made.drop("task").schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    pieces = max(PIECES, -(-made.rdd.getNumPartitions() // TASKS))
    _write(made.withColumn("piece", F.concat(F.lit("0-"), F.col("task") % pieces)).drop("task"), f"{path}/base-0", "piece")


def change(changed: DataFrame, key: str, old: str, new: str, path: str, number: int) -> None:
    """Write change `number` (from 1 on): changed has a row for each row that was inserted, deleted or updated.

    The keys that changed are kept under the empty trigram: whatever earlier folders say of them is void.
    """
    made = stored(changed, key, new, number).drop("task")
    touched = changed.filter(F.col(old).isNotNull() | F.col(new).isNotNull())
    named = {"trigram": F.lit(""), "keys": F.array(F.col(key))}
    touched = touched.select(*[named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in made.schema])
    _write(touched.unionByName(made), f"{path}/delta-{number}")


class _Folder:
    """The folders of an index, in whatever store they are."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
        self.files = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, within: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self.at(within))]

    def whole(self, name: str) -> bool:
        return self.files.exists(self.at(f"{name}/_SUCCESS"))

    def numbers(self, kind: str) -> list[int]:
        return sorted(int(n.split("-")[1]) for n in self.names() if n.startswith(kind + "-"))

    def mark(self, name: str) -> None:
        self.files.create(self.at(f"{name}/_SUCCESS"), True).close()

    def drop(self, name: str) -> None:
        self.files.delete(self.at(name), True)

    def read(self, *names: str) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(columns).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], columns)


def _state(folder: _Folder) -> tuple[int, dict[str, tuple[int, str]], list[int]]:
    """The newest complete base, its pieces (the changes that each covers, its folder), and the complete changes after it.

    A newer base that is still being made has taken over the pieces that are complete there; what it makes of later changes counts only when it's whole.
    """
    bases = folder.numbers("base")
    base = max((n for n in bases if folder.whole(f"base-{n}")), default=None)
    if base is None:
        raise ValueError(f"no index at {folder.path}")
    pieces = {p: (base, f"base-{base}/{p}") for p in folder.names(f"base-{base}") if p.startswith("piece=")}
    for n in (n for n in bases if n > base):
        for p in folder.names(f"base-{n}"):
            if p.startswith("piece=") and int(p[6:].split("-")[0]) <= base and folder.whole(f"base-{n}/{p}"):
                pieces[p] = (n, f"base-{n}/{p}")
    return base, pieces, [n for n in folder.numbers("delta") if n > base and folder.whole(f"delta-{n}")]


def _sources(pieces: dict[str, tuple[int, str]], changes: list[int]) -> dict[int, list[str]]:
    """Folders with rows, by the changes that they cover."""
    out: dict[int, list[str]] = {}
    for n, name in [*pieces.values(), *((n, f"delta-{n}") for n in changes)]:
        out.setdefault(n, []).append(name)
    return out


def _latest(folder: _Folder, changes: list[int]) -> DataFrame:
    """(touched, latest): the last change that names a key."""
    named = [folder.read(f"delta-{n}").filter("trigram = ''").select(F.explode("keys").alias("touched"), F.lit(n).alias("n")) for n in changes]
    return reduce(DataFrame.unionByName, named).groupBy("touched").agg(F.max("n").alias("latest"))


def _live(folder: _Folder, sources: dict[int, list[str]], changes: list[int]) -> DataFrame:
    """(segment, key, start, end): the texts that no later change has made void."""
    texts = reduce(DataFrame.unionByName, [_listed(folder.read(*names)).withColumn("number", F.lit(n)) for n, names in sources.items()] or [_listed(folder.read()).withColumn("number", F.lit(0))])
    if changes:
        latest = _latest(folder, changes)
        texts = texts.join(latest, texts["key"] == latest["touched"], "left").filter(F.col("latest").isNull() | (F.col("number") >= F.col("latest")))
    return texts.select("segment", "key", "start", "end")


def _probe(spark: SparkSession, path: str, trigrams: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Stored rows of the given trigrams, or of all, and the texts that count."""
    folder = _Folder(spark, path)
    _, pieces, changes = _state(folder)
    sources = _sources(pieces, changes)
    rows = folder.read(*[name for names in sources.values() for name in names])
    return rows.filter("trigram <> ''") if trigrams is None else rows.filter(F.col("trigram").isin(trigrams)), _live(folder, sources, changes)


def merged(spark: SparkSession, path: str, trigrams: list[str] | None = None) -> DataFrame:
    """(trigram, key, positions) after all changes; only those of the given trigrams are read."""
    return _opened(*_probe(spark, path, trigrams)).select("trigram", F.explode("postings").alias("p")).select("trigram", "p.key", "p.positions")


def _without(rows: DataFrame, void: DataFrame) -> DataFrame:
    """Stored rows without void texts (segment, start, end). These go to all tasks: a few numbers a text of one piece. No row is shuffled."""
    schema = rows.schema
    spans = void.select("segment", "start", "end").toArrow().sort_by([("segment", "ascending"), ("start", "ascending")])
    of, begins, ends_ = (spans.column(c).to_numpy().astype(np.int64) for c in ("segment", "start", "end"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, n in slices(whole.column("low")):
                batch = whole.slice(first, n)
                own, segment = np.unique(batch.column("segment").to_numpy(), return_inverse=True)
                # the void texts of these segments, in the order of segment and place
                number = np.minimum(np.searchsorted(own, of), len(own) - 1)
                here = own[number] == of
                begin, end = number[here] << 32 | begins[here], number[here] << 32 | ends_[here]
                bounds, place = _places(batch.column("low"), batch.column("high"))
                row = np.repeat(np.arange(n), np.diff(bounds))
                spot = segment[row] << 32 | place
                span = np.searchsorted(begin, spot, side="right") - 1
                live = (span < 0) | (spot >= end[span]) if len(end) else np.ones(len(spot), bool)
                size = np.bincount(row[live], minlength=n)
                texts = [None] * n
                for i in np.flatnonzero(batch.column("keys").is_valid().to_numpy(zero_copy_only=False)):
                    dead = {int(x) & 0xFFFFFFFF for x in begin[begin >> 32 == segment[i]]}
                    listed = zip(*(batch.column(c)[int(i)].as_py() for c in ("keys", "starts", "ends")), strict=True)
                    texts[i] = [t for t in listed if t[1] not in dead] or None
                columns = [batch.column(c) for c in ("trigram", "segment")] + _coded(place[live], np.concatenate([[0], np.cumsum(size)]))
                columns += [pa.array([t and [x[k] for x in t] for t in texts], batch.column(c).type) for k, c in enumerate(("keys", "starts", "ends"))]
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array((size > 0) | np.array([t is not None for t in texts])))

    return rows.mapInArrow(kept, schema)


def compact(spark: SparkSession, path: str) -> int:
    """Write a new base with all changes in it, a piece at a time; what it replaces goes. The number of changes that it covers."""
    folder = _Folder(spark, path)
    base, pieces, changes = _state(folder)
    if not changes:
        return base
    to, latest = changes[-1], _latest(folder, changes)
    sources = [(n, name, f"base-{to}/{piece}") for piece, (n, name) in sorted(pieces.items()) if n < to]
    added = [(n, f"delta-{n}") for n in changes]
    # void texts of all folders are found at once, and read by folder
    texts = [_listed(folder.read(name)).select("*", F.lit(n).alias("number"), F.lit(name).alias("source")) for n, name, *_ in [*sources, *added]]
    void = reduce(DataFrame.unionByName, texts).join(latest, (F.col("key") == F.col("touched")) & (F.col("latest") > F.col("number")))
    void = void.select("source", "segment", "start", "end")
    void.repartitionByRange("source", "segment").sortWithinPartitions("source").write.mode("overwrite").parquet(f"{path}/void")
    void = spark.read.schema(void.schema).parquet(f"{path}/void")
    rewritten = lambda name: _without(folder.read(name).filter("trigram <> ''"), void.filter(F.col("source") == name))
    for _, name, into in sources:
        _write(rewritten(name), f"{path}/{into}")
        folder.drop(name)
    _write(reduce(DataFrame.unionByName, [rewritten(name) for _, name in added]), f"{path}/base-{to}/piece={to}-0")
    folder.mark(f"base-{to}")
    for kind in ("base", "delta"):
        for n in folder.numbers(kind):
            if n < to or n == to and kind == "delta":
                folder.drop(f"{kind}-{n}")
    folder.drop("void")
    return to


def search(spark: SparkSession, path: str, texts: list[str]) -> DataFrame:
    """(search, key, matches): rows that contain each text, without regard to case, and at how many places. Texts have three characters or more."""
    wanted = []
    for text in texts:
        low = text.lower()
        if len(low) < 3:
            raise ValueError("a search needs three characters")
        wanted.append((text, len(low), [(low[o : o + 3], o) for o in sorted({*range(0, len(low) - 2, 3), len(low) - 3})]))
    rows, live = _probe(spark, path, sorted({t for _, _, parts in wanted for t, _ in parts}))

    def found(rows: pa.Table, keys: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        places = {}
        if rows.num_rows:
            bounds, place = _places(_one(rows.column("low")), _one(rows.column("high")))
            places = {t: place[bounds[i] : bounds[i + 1]] for i, t in enumerate(rows.column("trigram").to_pylist())}
        out = []
        for text, size, parts in wanted:
            if all(t in places for t, _ in parts):
                at = reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True), [places[t] - o for t, o in parts])
                owner = np.searchsorted(starts, at, side="right") - 1
                # a start and the end may be in two texts, or in one that is void
                own = owner[(owner >= 0) & (at + size <= ends[owner])]
                hit, n = np.unique(own, return_counts=True)
                out.append((pa.array([text] * len(hit), pa.string()), keys.take(pa.array(hit, pa.int64())), pa.array(n, pa.int64())))
        columns = [pa.chunked_array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), keys.type, pa.int64()))]
        return pa.table(dict(zip(("search", "key", "matches"), columns, strict=True)))

    return _of_texts(rows, live, found, f"search string, key {live.schema['key'].dataType.simpleString()}, matches long")
