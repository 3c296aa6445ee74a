"""Cutting texts into the pieces that a word-level BPE vocabulary merges inside.

The normaliser (NFC, lower case, white space) and the splitter of the vocabulary file never look across white space, so
a text is handled chunk by chunk (``chunks``) and the ids of each distinct chunk are kept.  Chunks of characters below
U+0250 are normalised and split here; any other chunk goes through the vocabulary's own normaliser and splitter, because
Python and the tokenizers library know different versions of Unicode.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import regex

from skillweave.llm.chunks import MOST_KEYS, ArrayStore, chunk_codes

PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Python counts these as white space, the vocabulary's rules don't.
SEPARATORS = regex.compile("[\x1c-\x1f]")
REAL_SPACE = regex.compile(r"[^\s\x1c-\x1f]+(?:[\x1c-\x1f]+[^\s\x1c-\x1f]*)*|[\x1c-\x1f]+(?:[^\s\x1c-\x1f]+[\x1c-\x1f]*)*")
LATIN = "ɏ"
#: Letters that normalisation leaves as they are and that are one piece.
ACCENTED = regex.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Signs that end words; an apostrophe isn't one, as it may begin a piece.
SIGNS = ".,;:!?%*#$&"
#: Pieces of chunks that aren't letters alone; so many are kept, beside those at hand.
MOST_PIECES = 100_000


def parts_of(text: str) -> list[str]:
    """What stands between white space, ASCII or not."""
    return REAL_SPACE.findall(text) if SEPARATORS.search(text) else text.split()


class PieceStore:
    """Ids of whole texts; ``encode`` is asked once for each distinct piece that isn't held."""

    def __init__(self, tokenizer, encode: Callable[[list[str]], Iterable[list[int]]], most: int = MOST_KEYS):
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.encode = encode
        self.pieces: dict[str, list[int]] = {}
        self.store = ArrayStore(self._learn, most)

    def pieces_of(self, part: str) -> list[str]:
        """The pieces of a part without white space, in the alphabet of bytes."""
        plain = part.isascii() and part.isprintable()
        if not plain:
            if max(part) <= LATIN:
                part = unicodedata.normalize("NFC", part)
            if max(part) > LATIN:
                return [p for p, _ in self.split(self.normalise(part))]
        low = part.lower()
        body = low.rstrip(SIGNS)
        if body.isalpha():  # one run of letters, and perhaps one of signs
            found = [body] if len(body) == len(low) else [body, low[len(body) :]]
        else:
            found = PIECE.findall(low)
        return found if plain else [p.encode().decode("latin-1").translate(_TABLE) for p in found]

    def _pieces(self, chunk: str) -> list[str | int]:
        """Pieces of a chunk, in order; a special token of the vocabulary stands as its id."""
        if self.cut is None or "<|" not in chunk:
            return list(chain.from_iterable(map(self.pieces_of, parts_of(chunk))))
        out: list[str | int] = []
        for k, part in enumerate(self.cut.split(chunk)):
            out += [self.special[part]] if k % 2 else chain.from_iterable(map(self.pieces_of, parts_of(part)))
        return out

    def _learn(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(keys)
        alone, pieces, rest = [], [], []
        for i, key in enumerate(keys):
            chunk = key.decode("utf-8", "replace")
            if key.isalpha():  # ASCII letters, or others below U+0100, only: one piece, met once
                alone.append(i)
                pieces.append(chunk.lower())
            elif ACCENTED(chunk):
                alone.append(i)
                pieces.append(chunk.lower().encode().decode("latin-1").translate(_TABLE))
            else:
                rest.append((i, self._pieces(chunk)))
        for i, ids in zip(alone, self.encode(pieces), strict=True):
            out[i] = ids
        if len(self.pieces) > MOST_PIECES:
            self.pieces = {}
        asked = list({p for _, ps in rest for p in ps if type(p) is str}.difference(self.pieces))
        self.pieces.update(zip(asked, self.encode(asked), strict=True))
        for i, ps in rest:
            out[i] = list(chain.from_iterable([p] if type(p) is int else self.pieces[p] for p in ps))
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(sizes.sum())), sizes

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (n+1 entries)."""
        keys, codes, first = chunk_codes(raw, offsets, cut=True)
        flat, begin = self.store.gather(keys, codes)
        return flat, begin[first]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


_ALPHABET = byte_alphabet()
_TABLE = dict(enumerate(_ALPHABET))
