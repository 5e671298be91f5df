"""Token ids in Arrow files of equal-length sequences, with masks.

Documents are sorted by id over ranges; each range's ids, an end id after each document, run on without gaps and are cut into sequences
of one length. A file is Arrow's stream format between magic words, with a footer that lists its batches: every batch has the same number of sequences
(the file's last one may have fewer) and two columns, `ids` (a fixed-size list of unsigned integers) and `mask` (a fixed-size list
of booleans: whether the place holds a token; only a file's last sequence has others, which are 0). As all sequences are equally long
and nothing is compressed, the place of any id follows from its number, and a reader that maps a local file gets arrays that
point into it, without a copy. Beside each file stands an index of the same format: doc_id, first (ids before it in the file) and n_tokens.

Each attempt of a task writes files under names of its own; only those that the table of files names are ever read, so a task that is
repeated, or an executor that is lost after it wrote, leaves nothing that counts. Files go through Arrow's file systems,
so that the shared folder may be a mounted one or any store that Arrow opens. They are closed and a new one begun after `file_ids` ids, so
that neither files nor the work of reading one grow with a range.

Ids take 16 bits in the files where the vocabulary allows it, else 32.

Defined results: null text is empty and holds the end id alone; equal ids are ordered by their text's hash, null ids first; repeated rows
stand side by side; an empty table gives no files and no rows; other columns are ignored; very long texts are encoded in blocks, one after the other.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import materialize, shared_dir

#: Ids of a sequence, sequences of a batch, ids of a file.
LENGTH, PER_BATCH, FILE_IDS = 2048, 64, 1 << 24
#: Text is cut before a blank between two characters that aren't white space, where no pre-token spans.
_BLOCK = 1 << 17
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters of the plain range, and the vocabulary's own pre-tokens for texts of that range only.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTERS}]*+\Z")
_PARTS = re.compile(rf" ?[{_LETTERS}]++|'(?:s|t|re|ve|m|ll|d)| ?[0-9]++| ?[^\s{_LETTERS}0-9]++|\s+(?!\S)|\s+")
#: Fixed value: the letter that stands for a blank in the vocabulary.
_BLANK = "\u0120"
#: Control characters that Python takes for white space and the vocabulary doesn't.
_ODD = re.compile("[\x1c-\x1f]")


def byte_bpe_path() -> str:
    """The vocabulary file of the byte-level tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def text_blocks(text: str, size: int = _BLOCK) -> Iterator[str]:
    """The text in parts of about that many characters, cut where the tokenizer cuts too. A part without such a place stays whole."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class ByteEncoder:
    """Unsigned 32-bit ids of texts, equal to the tokenizer's for each whole text.

    Pre-tokens that weren't met before are encoded together by the library; their ids stay in a table that is bounded by bytes.
    """

    def __init__(self, path: str, most_bytes: int = 48 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.left = Tokenizer.from_file(path), most_bytes
        self.known: dict[str, bytes] = {}
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for token, i in vocab.items() if token.startswith(_BLANK)]] = True

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens. A blank and letters always begin with a token that starts with the blank, so many such are encoded as one text."""
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        got = {}
        runs = [words[i : i + 200] for i in range(0, len(words), 200)]
        for own, ids in zip(runs, self._encoded(["".join(run) for run in runs])):
            at = np.flatnonzero(self.starts[ids]).tolist()
            if len(at) != len(own):
                raise ValueError("the vocabulary does not keep a word's blank with it")
            flat = ids.tobytes()
            got |= {p: flat[4 * i : 4 * j] for p, i, j in zip(own, at, [*at[1:], len(ids)])}
        others = [p for p in new if p not in got]
        return got | {p: ids.tobytes() for p, ids in zip(others, self._encoded(others))}

    def blocks(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some blocks, whose new pre-tokens are encoded together."""
        cuts = [None if not _PLAIN.match(text) or _ODD.search(text) or any(s in text for s in self.specials) else _PARTS.findall(text) for text in texts]
        known = self.known
        found = [None if cut is None else list(map(known.get, cut)) for cut in cuts]
        new = {p for cut, ids in zip(cuts, found) if ids is not None and None in ids for p, x in zip(cut, ids) if x is None}
        got = self._learned(list(new))
        out = []
        for text, cut, ids in zip(texts, cuts, found):
            if ids is None:
                out.append(self._encoded([text])[0].tobytes())
            else:
                out.append(b"".join([got[p] if x is None else x for p, x in zip(cut, ids)] if None in ids else ids))
        for p, ids in got.items():
            weight = len(p) + len(ids) + 180
            if self.left > 0 and weight < 1000:
                self.left -= weight
                known[p] = ids
        return out

    def ids(self, texts: list[str], at_once: int = 1 << 20) -> Iterator[list[bytes]]:
        """For each text its ids, as parts to join. About that many characters are cut at a time, so memory does not grow with a text."""
        owners: list[int] = []
        held: list[str] = []
        parts: dict[int, list[bytes]] = {}
        size = 0
        for k, text in enumerate(texts):
            parts[k] = []
            for block in text_blocks(text):
                owners.append(k)
                held.append(block)
                size += len(block)
                if size >= at_once:
                    for owner, ids in zip(owners, self.blocks(held)):
                        parts[owner].append(ids)
                    owners, held, size = [], [], 0
                    yield from (parts.pop(i) for i in [i for i in parts if i < k])
        for owner, ids in zip(owners, self.blocks(held)):
            parts[owner].append(ids)
        yield from (parts.pop(i) for i in list(parts))


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each worker process and file."""
    return ByteEncoder(path)


def _opened(uri: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """One file of sequences and its index, written batch by batch."""

    def __init__(self, folder: str, name: str, kind: pa.DataType, key: pa.DataType, length: int, per_batch: int):
        self.length, self.per_batch, self.kind = length, per_batch, kind
        self.fields = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", key), ("first", pa.int64()), ("n_tokens", pa.int64())])
        store, path = _opened(folder)
        store.create_dir(path, recursive=True)
        self.name, self.sinks = name, [store.open_output_stream(f"{path}/{name}{end}") for end in (".arrow", ".index.arrow")]
        self.out, self.rows = (pa.ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (self.fields, self.index)))
        self.pending: list[np.ndarray] = []
        self.held = self.total = self.docs = 0
        self.entries: list[list] = [[], [], []]

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * self.per_batch:
            self._flush(False)

    def close_document(self, doc_id: object, first: int) -> None:
        for into, x in zip(self.entries, (doc_id, first, self.total - first)):
            into.append(x)
        self.docs += 1
        if len(self.entries[0]) >= 1 << 14:
            self._write_index()

    def _write_index(self) -> None:
        self.rows.write_batch(pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(self.entries, self.index)], schema=self.index))
        self.entries = [[], [], []]

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.empty(0, self.kind.to_pandas_dtype()), *self.pending])
        step, at = self.length * self.per_batch, 0
        while len(ids) - at >= step:
            self._batch(ids[at : at + step], step)
            at += step
        self.pending, self.held = [ids[at:]], len(ids) - at
        if last and self.held:
            padded = np.zeros(-(-self.held // self.length) * self.length, ids.dtype)
            padded[: self.held] = ids[at:]
            self._batch(padded, self.held)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.fields))

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self._write_index()
        for x in (self.out, self.rows, *self.sinks):
            x.close()
        return self.name, self.total, self.docs


class SequenceReader:
    """Sequences by number and ids by place, pointing into the file where it is a local one."""

    def __init__(self, folder: str, name: str):
        store, path = _opened(folder)
        local = getattr(store, "type_name", "") == "local"
        open_ = pa.memory_map if local else store.open_input_file
        self.source, self.rows = (open_(f"{path}/{name}{end}") for end in (".arrow", ".index.arrow"))
        self.file, self.index = pa.ipc.open_file(self.source), pa.ipc.open_file(self.rows)
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows
        self.near: tuple[int, pa.RecordBatch] = (-1, None)

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.near[0] != k:
            self.near = (k, self.file.get_batch(k))
        return self.near[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of the file's sequence k."""
        row, batch = k % self.per_batch, self._batch(k // self.per_batch)
        ids, mask = (batch.column(i).flatten().slice(row * self.length, self.length) for i in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def ids(self, first: int, count: int) -> Iterator[np.ndarray]:
        """count ids from place first on, one view for each batch that they touch."""
        step = self.length * self.per_batch
        while count > 0:
            k, at = divmod(first, step)
            values = self._batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            part = values[at : at + count]
            yield part
            first, count = first + len(part), count - len(part)

    def documents(self) -> Iterator[pa.RecordBatch]:
        """doc_id, first and n_tokens, in order."""
        for k in range(self.index.num_record_batches):
            yield self.index.get_batch(k)

    def close(self) -> None:
        self.near = (-1, None)
        self.source.close()
        self.rows.close()


def token_folder(spark: SparkSession) -> str:
    """A new folder under the shared one, removed when the application ends."""
    from ._tables import _files

    folder = f"{shared_dir(spark)}/verbatlas-tokens-{uuid.uuid4().hex}"
    files, at = _files(spark, folder)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") else folder if "://" in folder else f"file://{folder}"


def write_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, length: int = LENGTH, per_batch: int = PER_BATCH, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts, ascending by doc_id; a row per file: folder, name, file_start (ids in all files before it), n_ids, n_docs.

    The table of files, not the folder, says which files count; it is written to the shared folder, too.
    """
    spark = docs.sparkSession
    folder = folder or token_folder(spark)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text import slices

        task = TaskContext.get()
        part, encode, out, n = task.partitionId(), byte_encoder(path), None, 0
        kind = pa.uint16() if encode.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
        number, end = kind.to_pandas_dtype(), np.array([end_id], kind.to_pandas_dtype())
        done: list[tuple] = []
        for batch in (x for whole in batches for x in slices(whole, 1)):
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, parts in zip(batch.column(0).to_pylist(), encode.ids(texts), strict=True):
                if out is None:
                    name = f"part-{part:06d}-{n:05d}-{uuid.uuid4().hex}"
                    out, n = SequenceWriter(folder, name, kind, batch.schema.field(0).type, length, per_batch), n + 1
                first = out.total
                for ids in parts:
                    out.add(np.frombuffer(ids, "<u4").astype(number))
                out.add(end)
                out.close_document(doc_id, first)
                if out.total >= file_ids:
                    done.append((part, n, *out.close()))
                    out = None
        if out is not None:
            done.append((part, n, *out.close()))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = [pa.array([row[i] for row in done], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "nth", "name", "n_ids", "n_docs"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("lot", F.monotonically_increasing_id())
    order = ["doc_id", F.xxhash64("text"), "lot"]
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = materialize(ranged.mapInArrow(written, "part int, nth int, name string, n_ids long, n_docs long"), "token-files")
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    kind = docs.schema["doc_id"].dataType.simpleString()
    starts = files.select(F.lit(folder).alias("folder"), "name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"), "n_ids", "n_docs")
    return materialize(starts.withColumn("doc_id", F.lit(None).cast(kind)), "token-starts")


def documents_of(files: DataFrame) -> DataFrame:
    """doc_id, file_start, first, n_tokens and ids_crc32 (unsigned, of little-endian unsigned 32-bit ids) of every document, read from the files.

    A task reads whole files, through their maps and one batch at a time; files are dealt to as many partitions as there are files, up to ten thousand.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader = SequenceReader(folder, name)
                for rows in reader.documents():
                    sums = []
                    for first, count in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                        crc = 0
                        for ids in reader.ids(first, count):
                            crc = zlib.crc32(ids.astype("<u4", copy=False), crc)
                        sums.append(crc)
                    starts = pa.array(np.full(rows.num_rows, start, np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column(0), starts, rows.column(1), rows.column(2), pa.array(sums, pa.int64())], ["doc_id", "file_start", "first", "n_tokens", "ids_crc32"])
                reader.close()

    kind = files.schema["doc_id"].dataType.simpleString()
    count = min(max(files.count(), 1), 10_000)
    dealt = files.select("folder", "name", "file_start").repartition(count, "name")
    return dealt.mapInArrow(read, f"doc_id {kind}, file_start long, first long, n_tokens long, ids_crc32 long")
