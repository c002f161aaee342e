"""Token ids by a public tokenizer file, with a bounded cache of words.

The tokenizer's own steps (normalise, split, merge) never look across ASCII
white space, so a text's ids are those of its white-space-separated chunks, one
after another.  Chunks repeat, so each worker keeps the ids of those it has
met, up to a bound; results do not depend on the cache.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Letters for which lower-casing and splitting need no Unicode tables:
#: printable ASCII and the Latin-1 letters.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|[^a-zà-öø-ÿ0-9]+")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """``word_bpe_49k.json`` over chunks; :meth:`ids` equals the tokenizer over the whole text."""

    def __init__(self, path: str | None = None, bound: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = True
        self.bound = bound
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        plain = [chr(c) for c in range(0x21, 0x100) if _PLAIN.match(chr(c))]
        self.shown = str.maketrans({c: split(c.lower())[0][0] for c in plain if c == c.lower()})

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = np.array([t.id for t in self.tokenizer.model.tokenize(piece)], self.width).tobytes()
            if len(self.pieces) < self.bound:
                self.pieces[piece] = got
        return got

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        if _PLAIN.match(text):
            pieces = [p.translate(self.shown) for p in _PIECES.findall(text.lower())]
        else:
            shown = self.tokenizer.normalizer.normalize_str(text)
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(shown)]
        got = b"".join(map(self._piece, pieces))
        if len(self.chunks) < self.bound and len(chunk) < 64:
            self.chunks[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` (no special tokens), as little-endian integers of ``width``."""
        known, out = self.chunks.get, []
        for chunk in text.encode("utf-8").split():
            got = known(chunk)
            out.append(self._chunk(chunk) if got is None else got)
        return b"".join(out)


_OPEN: dict[str | None, ChunkTokenizer] = {}


def tokenizer(path: str | None = None) -> ChunkTokenizer:
    """The worker's tokenizer for ``path``, opened once."""
    if path not in _OPEN:
        _OPEN[path] = ChunkTokenizer(path)
    return _OPEN[path]
