"""Token ids of whole texts, exact, from the ids of their distinct pre-tokens.

The vocabulary is one that drops white space: no token and no pre-token spans it. Texts are cut at white space into blocks,
blocks into pre-tokens, and those that no earlier block had are encoded together by the tokenizer library, once each.
A worker keeps the ids of pre-tokens in a table that is bounded by bytes, so that neither long nor many of them can fill its memory.
"""

from __future__ import annotations

import os
import re
from functools import cached_property, lru_cache

import numpy as np

from .text import blocks

#: Printable ASCII and the Latin letters that normalising leaves alone, and the vocabulary's own pre-tokens for them.
_PLAIN = "!-~À-ÖØ-öø-įı-ſ"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\t-\r a-zß-öø-ſ0-9]+")
#: A run between white space that has another character: it's left to the library as it is.
_OTHER = re.compile(rf"((?<![^\t-\r ])[{_PLAIN}]*+[^{_PLAIN}\t-\r ][^\t-\r ]*)")
_STRANGE = re.compile(rf"[^{_PLAIN}\t-\r ]")
#: What an entry of the table weighs beside its strings, and how much text is worked on at once.
_ENTRY, _AT_ONCE = 180, 1 << 20
_TOGETHER = 200


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """ids(text) -> little-endian unsigned 32-bit ids, equal to the tokenizer's for the whole text; ids_of does many texts together."""

    def __init__(self, path: str, most_bytes: int = 32 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.path, self.bare, self.left = path, Tokenizer.from_file(path), most_bytes
        # pre-tokens come in the vocabulary's own letters and in lower case, so that this one has to cut at spaces only
        self.bare.normalizer, self.bare.pre_tokenizer = None, WhitespaceSplit()
        self.specials = [x.content.encode() for x in self.bare.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        vocab = self.bare.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is in its file, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, block: bytes) -> list[str]:
        """The block's pre-tokens in order, in lower case, and in their place the runs that are left to the library."""
        text = block.decode()
        if not _STRANGE.search(text):
            return _PARTS.findall(text.lower())
        out: list[str] = []
        for k, part in enumerate(_OTHER.split(text)):
            if k % 2:
                out.append(part)
            else:
                out += _PARTS.findall(part.lower())
        return out

    def _learn(self, parts: list[str]) -> None:
        """Enter the ids of new pre-tokens."""
        strange = set(filter(_STRANGE.search, parts))
        plain = [p for p in parts if p not in strange] if strange else parts
        for p in strange:
            self.known[p] = self._whole(p)
        shown = [p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in plain]
        texts = [" ".join(shown[i : i + _TOGETHER]) for i in range(0, len(shown), _TOGETHER)]
        for k, got in enumerate(self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            upto = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            own, flat, at = plain[k * _TOGETHER : (k + 1) * _TOGETHER], ids.tobytes(), 0
            if len(upto) != len(own):
                raise ValueError("the vocabulary does not mark the ends of words")
            for p, end in zip(own, upto):
                self.known[p] = flat[at:end]
                at = end

    def _joined(self, cuts: list[list[str]]) -> list[bytes]:
        new = list(set().union(*cuts).difference(self.known))
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, cut)) for cut in cuts]
        for p in new:
            weight = len(p) + len(self.known[p]) + _ENTRY
            if self.left > 0 and weight < 1000:
                self.left -= weight
            else:
                del self.known[p]
        return out

    def ids_of(self, bodies: list[bytes]) -> list[bytes]:
        """The ids of each text. About 1 MB of text is cut at a time, so that memory does not grow with texts or their number."""
        owner, cuts, size = [], [], 0
        done: list[list[bytes]] = []

        def flush() -> None:
            nonlocal size
            for k, ids in zip(owner, self._joined(cuts), strict=True):
                done[k].append(ids)
            owner.clear()
            cuts.clear()
            size = 0

        for body in bodies:
            done.append([])
            for block, _ in blocks(body):
                if any(x in block for x in self.specials):
                    flush()
                    done[-1].append(self._whole(block.decode()))
                    continue
                owner.append(len(done) - 1)
                cuts.append(self._cut(block))
                size += len(block)
                if size >= _AT_ONCE:
                    flush()
        flush()
        return [b"".join(parts) for parts in done]

    def ids(self, body: bytes) -> bytes:
        return self.ids_of([body])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    return PieceEncoder(path)


def word_bpe_path() -> str:
    """The vocabulary file of the lower-casing word tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
