"""Tokens of documents cut in slices of Arrow batches: the same rows as the column functions in `functions.text`, without an array of tokens in a row.

A slice of about 1 MB of texts becomes one array of code points; tokens, sentences and segments are where its classes change, so
numpy finds them for all texts of a slice at once. Stages stay narrow, and Python holds one slice at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.functions.text import LETTERS
from verbatlas.sources.tables import slices

#: Classes of code points, and the largest code point whose case variants are looked at.
OTHER, WORD, WHITE = 0, 1, 2
_CASED = 0x1E00


@cache
def classes() -> np.ndarray:
    """The class of every code point: a letter of the tagger's words in any case, white space, or another."""
    table = np.full(0x110000, OTHER, np.uint8)
    table[[ord(c) for c in " \t\n\v\f\r"]] = WHITE
    table[[ord(c) for c in "_0123456789"]] = WORD
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1] = WORD
    own = {*LETTERS.replace("а-я", ""), *map(chr, range(ord("а"), ord("я") + 1))}
    table[[i for i in range(128, _CASED) if own & {chr(i), chr(i).upper(), chr(i).upper().lower()}]] = WORD
    return table


@dataclass
class Cut:
    """Tokens of some texts in order, one entry each; text: the text's number, apart: whether white space or nothing stands before."""

    text: np.ndarray
    token_index: np.ndarray
    segment: np.ndarray
    sentence_no: np.ndarray
    word: np.ndarray
    apart: np.ndarray
    surface: pa.Array


def _count(marks: np.ndarray, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many marks there are up to each token in its text, this one included; starts: each text's first token."""
    sums = np.cumsum(marks, dtype=np.int64)
    before = np.concatenate([[0], sums])[starts]
    return (sums - before[text]).astype(np.int32)


def cut(texts: pa.Array) -> Cut:
    """The tokens of texts: runs of word characters, or of others that are no white space; blank lines end segments, white space after .!? ends sentences."""
    plain = [b.decode("utf-8", "replace") if b else "" for b in texts.cast(pa.binary()).to_pylist()]
    # a blank before each text keeps texts apart
    whole = "".join(" " + t for t in plain)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in plain], dtype=np.int64)
    kind = classes()[points]
    turn = np.flatnonzero(np.diff(kind)) + 1
    first = np.concatenate([[0], turn]) if len(points) else turn
    last = np.concatenate([turn, [len(points)]]) if len(points) else turn
    token = kind[first] != WHITE
    begin, end = first[token], last[token]
    text = np.searchsorted(ends, begin, side="right")
    starts = np.searchsorted(text, np.arange(len(plain)))
    apart = kind[begin - 1] == WHITE
    fresh = np.zeros(len(begin), bool)
    fresh[starts[starts < len(begin)]] = True
    # a text without tokens has the start of the next one, which is a start as well
    lines = np.concatenate([[0], np.cumsum(points == ord("\n"))])
    previous = np.concatenate([[0], end[:-1]]) if len(end) else end
    segment = fresh | (lines[begin] - lines[previous] >= 2)
    stop = np.isin(points[np.maximum(previous - 1, 0)], [ord(c) for c in ".!?"]) if len(end) else fresh
    sentence = segment | (apart & stop)
    word = kind[begin] == WORD
    # the bytes of all tokens, without the white space between them
    raw = np.frombuffer(whole.encode("utf-8"), np.uint8)
    width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    kept = raw[np.repeat(kind != WHITE, width)]
    offsets = np.concatenate([[0], np.cumsum(place[end] - place[begin])]).astype(np.int32)
    surface = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    every = np.ones(len(begin), bool)
    index = _count(every, starts, text) - 1
    return Cut(text, index, _count(segment, starts, text) - 1, _count(sentence, starts, text) - 1, word, apart, surface)


def sliced(docs: DataFrame, keep: list[str], schema: str, rows: Callable[[pa.StructArray, pa.Array, Cut], list[pa.Array]]) -> DataFrame:
    """docs (any columns to keep, text) as the rows that `rows` makes of the kept columns, the texts and their tokens, a slice at a time.

    schema: the columns that `rows` makes; `kept` comes first, if any column is kept.
    """
    frame = docs.select(F.struct(*(keep or [F.lit(0)])).alias("kept"), "text")
    names = [f.split()[0] for f in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in slices(batch.column(1)):
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays(rows(part.column(0), part.column(1), cut(part.column(1))), names)

    kind = frame.schema["kept"].dataType.simpleString()
    return frame.mapInArrow(made, schema.replace("kept, ", f"kept {kind}, ", 1))


def positions(docs: DataFrame, *keep: str) -> DataFrame:
    """The rows of `corpus.positions`: doc_id, any columns to keep, token_index, segment, sentence_no, surface, word_index."""

    def rows(kept: pa.StructArray, _: pa.Array, t: Cut) -> list[pa.Array]:
        words = np.cumsum(t.word)
        before = (words - t.word)[np.maximum(np.arange(len(words)) - t.token_index, 0)] if len(words) else words
        number = np.where(t.word, words - before - 1, -1).astype(np.int32)
        return [kept.take(pa.array(t.text)), *map(pa.array, (t.token_index, t.segment, t.sentence_no)), t.surface, pa.array(number)]

    out = sliced(docs, ["doc_id", *keep], "kept, token_index int, segment int, sentence_no int, surface string, word_index int", rows)
    return out.select("kept.*", "token_index", "segment", "sentence_no", "surface", "word_index")


@dataclass
class Forms:
    """Distinct surfaces of each text, ordered by text: its number, the surface, whether it is a word, how often it stands there; at: each token's entry."""

    text: np.ndarray
    surface: pa.Array
    word: np.ndarray
    n: np.ndarray
    at: np.ndarray


def forms(t: Cut) -> Forms:
    """The distinct surfaces of each text of a slice."""
    coded = t.surface.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, first, at, n = np.unique(t.text * size + codes, return_index=True, return_inverse=True, return_counts=True)
    return Forms(pairs // size, coded.dictionary.take(pa.array(pairs % size)), t.word[first], n, at)


def lists(owner: np.ndarray, owners: int, values: pa.Array) -> pa.ListArray:
    """One list for each of so many owners, from values in the owners' order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(owners + 1)).astype(np.int32)), values)


def words(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, any columns to keep, surface, n: the distinct words of each document as they are written, and how often each stands there."""

    def rows(kept: pa.StructArray, _: pa.Array, t: Cut) -> list[pa.Array]:
        f = forms(t)
        return [kept.take(pa.array(f.text[f.word])), f.surface.filter(pa.array(f.word)), pa.array(f.n[f.word])]

    return sliced(docs, ["doc_id", *keep], "kept, surface string, n long", rows).select("kept.*", "surface", "n")


def indexed(docs: DataFrame, known: str, *keep: str) -> DataFrame:
    """doc_id, any columns to keep, forms, sentences: each document as its distinct surfaces and the places of its tokens among them.

    forms: array<struct<surface, known>>; sentences: array<struct<segment, tokens>>, tokens being places in forms, from 0. The column `known` lists
    surfaces of the document that are known, by a property of the surface alone, so that those of a slice are looked up together.
    """

    def rows(kept: pa.StructArray, _: pa.Array, t: Cut) -> list[pa.Array]:
        f, texts = forms(t), len(kept)
        sure = pc.is_in(f.surface, value_set=pc.unique(kept.field(known).flatten()))
        places = pa.array((f.at - np.searchsorted(f.text, t.text)).astype(np.int32))
        start = np.flatnonzero((np.diff(t.sentence_no, prepend=-1) != 0) | (t.token_index == 0))
        tokens = pa.ListArray.from_arrays(pa.array(np.append(start, len(t.text)).astype(np.int32)), places)
        sentences = pa.StructArray.from_arrays([pa.array(t.segment[start]), tokens], ["segment", "tokens"])
        return [kept, lists(f.text, texts, pa.StructArray.from_arrays([f.surface, sure], ["surface", "known"])), lists(t.text[start], texts, sentences)]

    schema = "kept, forms array<struct<surface:string,known:boolean>>, sentences array<struct<segment:int,tokens:array<int>>>"
    return sliced(docs, ["doc_id", known, *keep], schema, rows).select("kept.*", "forms", "sentences").drop(known)


def vocabulary(docs: DataFrame) -> DataFrame:
    """surface, word, n: the distinct surfaces of each slice of texts, whether they are words, and their counts; the caller sums slices up."""

    def rows(kept: pa.StructArray, _: pa.Array, t: Cut) -> list[pa.Array]:
        coded = t.surface.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        word = np.zeros(len(coded.dictionary), bool)
        word[codes] = t.word
        n = np.bincount(codes, minlength=len(word)) if len(codes) else np.zeros(0, np.int64)
        return [coded.dictionary, pa.array(word), pa.array(n)]

    return sliced(docs, [], "surface string, word boolean, n long", rows)


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, token_index, surface, next: every token but the last of its sentence, with the one after it."""

    def rows(kept: pa.StructArray, _: pa.Array, t: Cut) -> list[pa.Array]:
        i = np.flatnonzero((t.text[1:] == t.text[:-1]) & (t.sentence_no[1:] == t.sentence_no[:-1]))
        at = pa.array(i)
        return [kept.take(pa.array(t.text[i])), pa.array(t.token_index[i]), t.surface.take(at), t.surface.take(pa.array(i + 1))]

    return sliced(docs, ["doc_id"], "kept, token_index int, surface string, next string", rows).select("kept.doc_id", "token_index", "surface", "next")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, words, sentences, space_words, forms: one row a document with its counts and its distinct words, array<struct<surface, n>>.

    space_words: the runs of characters between white space.
    """

    def rows(kept: pa.StructArray, _: pa.Array, t: Cut) -> list[pa.Array]:
        f, texts = forms(t), len(kept)
        number = lambda marks: pa.array(np.bincount(t.text, marks, texts).astype(np.int64))
        sentence = np.diff(t.sentence_no, prepend=-1) != 0
        word = pa.array(f.word)
        items = pa.StructArray.from_arrays([f.surface.filter(word), pa.array(f.n[f.word])], ["surface", "n"])
        every = np.ones(len(t.text), bool)
        return [kept, number(every), number(t.word), number(sentence | (t.token_index == 0)), number(t.apart), lists(f.text[f.word], texts, items)]

    schema = "kept, tokens long, words long, sentences long, space_words long, forms array<struct<surface:string,n:bigint>>"
    out = sliced(docs, ["doc_id"], schema, rows)
    return out.select("kept.doc_id", "tokens", "words", "sentences", "space_words", "forms")
