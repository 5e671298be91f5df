"""Token counts that follow edits, from a segment tree of each document's pre-tokens.

A document is a row of segments: runs of up to `width` white-space delimited pre-tokens, each with
its character and token counts. A binary tree over the segments holds subtree sums. An edit replaces the
characters from start to end; the tree finds the segments it touches, one more on either side is
taken as boundary context, their joined text is edited and encoded again, and only the sums above
them change. All other segments keep their counts. The vocabulary drops white space, so segments that
end in white space are independent of what follows.

Defined results: null text is the empty text, with no tokens; edits are applied one after the other,
each to the text that the ones before left; positions beyond the text count as its end; an edit with
start after end is an insertion at start; no edits (or a null list of them) leave the counts as they are; an edit's null text is
empty; repeated rows get equal counts; an empty table gives no rows; other columns are ignored. A very long text is many
segments and is encoded in blocks; a single very long word is one segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens end at the white space that the tokenizer's blocks end at, so other white space stays inside them.
_RUN = re.compile(r"[^\t-\r ]*[\t-\r ]+|[^\t-\r ]+\Z")


class CountTree:
    """Segments of one text, with sums of characters and tokens over a binary tree."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], width: int = 32):
        self.count, self.encoded = count, 0
        runs = _RUN.findall(text)
        self.segments = ["".join(runs[i : i + width]) for i in range(0, len(runs), width)] or [""]
        self.leaves = 1 << (len(self.segments) - 1).bit_length()
        self.segments += [""] * (self.leaves - len(self.segments))
        self.chars = [0] * self.leaves + [len(s) for s in self.segments]
        self.tokens = [0] * self.leaves + self.count(self.segments)
        for sums in (self.chars, self.tokens):
            for i in range(self.leaves - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.segments)

    def locate(self, char: int) -> tuple[int, int]:
        """The segment that holds the position, and the position in it."""
        node = 1
        while node < self.leaves:
            node *= 2
            if char >= self.chars[node] and self.chars[node + 1]:
                char -= self.chars[node]
                node += 1
        return node - self.leaves, char

    def _beside(self, leaf: int, step: int) -> int:
        """The next segment with text in that direction, or the same one: up the tree to a sum that is not 0, then down."""
        node = leaf + self.leaves
        while node > 1:
            side = node + step
            if side // 2 == node // 2 and self.chars[side]:
                node = side
                while node < self.leaves:
                    node = 2 * node + (step < 0)
                    if not self.chars[node]:
                        node ^= 1
                return node - self.leaves
            node //= 2
        return leaf

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), self.chars[1])
        end = min(max(end, start), self.chars[1])
        first, at = self.locate(start)
        last = first if end == start else self.locate(end - 1)[0]
        low, high = self._beside(first, -1), self._beside(last, 1)
        at += sum(len(s) for s in self.segments[low:first])
        old = "".join(self.segments[low : high + 1])
        joined = old[:at] + new + old[at + end - start :]
        self.encoded += len(joined)
        self._set(low, joined)
        for leaf in range(low + 1, high + 1):
            if self.segments[leaf]:
                self._set(leaf, "")

    def _set(self, leaf: int, text: str) -> None:
        self.segments[leaf] = text
        for sums, value in ((self.chars, len(text)), (self.tokens, self.count([text])[0])):
            node = leaf + self.leaves
            change = value - sums[node]
            while node:
                sums[node] += change
                node //= 2


def count_edited(docs: DataFrame, path: str) -> DataFrame:
    """Counts before and after edits, of (doc_id, text, edits array<struct<start, end, new>>).

    Returns doc_id, n_chars, n_tokens, n_edits, edited_chars, edited_tokens, encoded_chars: the last is what
    had to be encoded again. Each document is read whole and once; nothing is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text import slices
        from .tokens import encoder

        encode = encoder(path).ids_of
        count = lambda texts: [len(x) // 4 for x in encode([s.encode() for s in texts])]
        for batch in (x for whole in batches for x in slices(whole, 1)):
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, text, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = CountTree(text or "", count)
                before = (doc_id, tree.chars[1], tree.total(), len(edits or ()))
                for e in edits or ():
                    tree.edit(e["start"], e["end"], e["new"] or "")
                for into, x in zip(rows, (*before, tree.chars[1], tree.total(), tree.encoded)):
                    into.append(x)
            kinds = [batch.schema.field(0).type] + [pa.int64()] * 6
            names = ["doc_id", "n_chars", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "encoded_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    spec = f"doc_id {kind}, n_chars long, n_tokens long, n_edits long, edited_chars long, edited_tokens long, encoded_chars long"
    return docs.select("doc_id", "text", "edits").mapInArrow(counted, spec)


#: What the production edit removes: mail addresses and long digit or hexadecimal keys.
PRIVATE = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}[.][A-Za-z0-9.-]{1,63}|\b[0-9a-f]{32,}\b|\b[0-9][0-9 ().-]{7,20}[0-9]\b"


def redactions(docs: DataFrame, pattern: str = PRIVATE, new: str = "[removed]") -> DataFrame:
    """docs with an `edits` column that replaces what the pattern finds, last match first.

    Positions are in code points. Taken from the back, an edit leaves the positions of the others as they are.
    Only documents with a match reach the Python function with work to do.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .text import slices

        wanted = re.compile(pattern, re.ASCII)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("new", pa.string())]))
        for batch in (x for whole in batches for x in slices(whole, 1)):
            edits = [
                [{"start": m.start(), "end": m.end(), "new": new} for m in reversed(list(wanted.finditer(text or "")))]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(edits, kind)], ["doc_id", "text", "edits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(found, f"doc_id {kind}, text string, edits array<struct<start: long, end: long, new: string>>")
