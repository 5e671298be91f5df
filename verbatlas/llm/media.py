"""Texts as lossless progressive-JPEG media, read back as payload, RGB tensors and features.

Each text is handled alone, in Arrow batches, without a shuffle. Images are decoded to RGB in strips, so that long
texts need a bounded amount of memory beside their coefficients.

Defined results: null text is the empty text; the empty text's payload is 64 bytes 0; equal texts get equal values;
repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .jpeg import decode, encode_bytes, payload_of, strips
from .text import bodies, slices


def padded(body: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))


def feature(media: bytes) -> str:
    """Size, channel means and mean absolute steps between all neighbours along rows of the decoded RGB, from exact integer sums."""
    return _described(decode(media))


def _described(image) -> str:
    sums, steps = np.zeros(3, np.int64), np.zeros(3, np.int64)
    for rgb in strips(image):
        sums += rgb.sum((0, 1), dtype=np.int64)
        steps += np.abs(np.diff(rgb.astype(np.int16), axis=1)).sum((0, 1), dtype=np.int64)
    n, pairs = image.width * image.height, max(1, (image.width - 1) * image.height)
    return f"{image.width}x{image.height};" + ";".join("%.3f,%.3f" % (a / n, b / pairs) for a, b in zip(sums, steps))


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the JPEG of every text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in batches for x in slices(whole, 1, most_rows=256)):
            texts = [b or b"" for b in bodies(part.column(1))]
            media = pa.array([encode_bytes(padded(b)) for b in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, n_bytes long, media binary")


def read_back(media: DataFrame, tensors: bool = False) -> DataFrame:
    """What the media hold: payload digests, media digests, a feature, and if asked the RGB tensor with its size."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole, 2, most_rows=256)):
            rows: list[list] = [[] for _ in range(9 if tensors else 6)]
            for body in batch.column(2).to_pylist():
                image = decode(body)
                payload = payload_of(image)
                values = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(body), hashlib.sha256(body).hexdigest(), _described(image)]
                if tensors:
                    values += [image.height, image.width, b"".join(s.tobytes() for s in strips(image))]
                for into, x in zip(rows, values, strict=True):
                    into.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(rows, kinds))], ["doc_id", "n_bytes", *names[: len(rows)]])

    spec = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(decoded, spec + ", height int, width int, rgb binary" * tensors)
