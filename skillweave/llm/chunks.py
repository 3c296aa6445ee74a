"""Texts as codes of their distinct chunks, and a bounded store of what each chunk stands for.

A chunk is a maximal run of bytes without ASCII white space.  The chunks of many texts are found, hashed and numbered by
numpy and Arrow, so Python sees each distinct chunk of a batch once, however often it stands there.  A very long chunk
is one key; nothing is quadratic in it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from skillweave.llm.shared import SPACES

SPACE, LETTER, DIGIT, SIGN, HARD = range(5)


def _classes() -> np.ndarray:
    """The class of each byte.  ``HARD`` ones (beyond ASCII, control bytes, apostrophes, bars) forbid cutting a chunk."""
    out = np.full(256, HARD, np.uint8)
    out[33:127] = SIGN
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    out[list(b"'|")] = HARD
    out[list(SPACES)] = SPACE
    return out


CLASS = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: First byte of U+00C0 to U+00FF in UTF-8; of their second bytes these two are no letters, and those below 0x9F capitals.
LATIN_LEAD, TIMES, DIVIDED, SHARP_S = 0xC3, 0x97, 0xB7, 0x9F
#: Keys, and bytes of keys, of one generation of a store at most, beside those of the slice at hand.
MOST_KEYS, MOST_KEY_BYTES = 250_000, 8_000_000


def chunk_codes(raw: np.ndarray, offsets: np.ndarray, cut: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct chunks, the number of each chunk in order, and each text's first place in that order (n+1 entries).

    ``cut`` divides chunks without ``HARD`` bytes further into runs of letters (ASCII or U+00C0 to U+00FF), runs of signs
    and single digits.  Letters are lower-cased, unless a text holds ``<|``, with which special tokens begin.
    """
    n = len(raw)
    if not n:
        return [], np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = CLASS[raw]
    inside = kind != SPACE
    begins = np.empty(n, bool)
    begins[0] = True
    np.logical_not(inside[:-1], out=begins[1:])
    begins[offsets[(offsets > 0) & (offsets < n)]] = True
    chunk_at = np.flatnonzero(begins & inside)
    ends = np.empty(n, bool)
    ends[-1] = True
    ends[:-1] = begins[1:] | ~inside[1:]
    chunk_end = np.flatnonzero(ends & inside) + 1
    lower = b"<|" not in raw.tobytes()
    if cut and len(chunk_at):
        lead = np.flatnonzero(raw[:-1] == LATIN_LEAD)
        if len(lead):
            after = raw[lead + 1]
            fine = (after != TIMES) & (after != DIVIDED)
            kind[lead[fine]] = kind[lead[fine] + 1] = LETTER
            if lower and len(large := lead[fine & (after < SHARP_S)]):
                raw = raw.copy()
                raw[large + 1] += 32
        hard = np.maximum.reduceat(kind, chunk_at) == HARD
        change = begins.copy()
        change[1:] |= kind[1:] != kind[:-1]
        change |= kind == DIGIT
        at = np.flatnonzero(change & inside)
        whole = begins[at]  # the first piece of a chunk
        chunk = np.cumsum(whole, dtype=np.int32) - 1
        keep = whole | ~hard[chunk]
        at, chunk = at[keep], chunk[keep]
        stop = np.append(at[1:], n)
        length = np.minimum(stop, chunk_end[chunk]) - at
    else:
        at, length = chunk_at, chunk_end - chunk_at
    data = LOWER[raw[inside]] if lower else raw[inside]
    places = np.zeros(len(at) + 1, np.int64)
    np.cumsum(length, out=places[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    return _values(coded.dictionary), coded.indices.to_numpy(), np.searchsorted(at, offsets, "left")


def _values(column: pa.Array) -> list[bytes]:
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class ArrayStore:
    """key -> a short row of 32-bit integers, computed once for each key as long as it is held.

    Two generations are kept: when the newer one is full it becomes the older, and keys that are met again move back, so
    that what is frequent is never computed anew.  Results never depend on what is held.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MOST_KEYS, most_bytes: int = MOST_KEY_BYTES):
        """``compute``: keys -> all their integers end to end, and how many each key has."""
        self.compute, self.most, self.most_bytes = compute, most, most_bytes
        self.places: dict[bytes, int] = {}
        self._rotate()

    def _rotate(self) -> None:
        self.older = (self.places, self.flat, self.begin) if self.places else ({}, None, None)
        self.places, self.held, self.used = {}, 0, 0
        self.flat, self.begin = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64)

    def _add(self, keys: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.places)
        if n + len(keys) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(max(len(self.begin), len(keys) + 1), np.int64)])
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[n + 1 : n + 1 + len(keys)] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.held += sum(map(len, keys))
        self.places.update(zip(keys, range(n, n + len(keys)), strict=True))

    def gather(self, keys: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The integers of ``keys[c]`` for all codes c, end to end, and where each code's begin (n+1 entries)."""
        found = list(map(self.places.get, keys))
        new = [i for i, at in enumerate(found) if at is None]
        if new and (len(self.places) + len(new) > self.most or self.held > self.most_bytes):
            self._rotate()
            found, new = [None] * len(keys), range(len(keys))
        if new:
            before, flat, begin = self.older
            again = [i for i in new if keys[i] in before]
            if again:
                self._add([keys[i] for i in again], *_rows(flat, begin, np.array([before[keys[i]] for i in again])))
                new = [i for i in new if keys[i] not in before]
            if new:
                asked = [keys[i] for i in new]
                self._add(asked, *self.compute(asked))
            for at, i in enumerate([*again, *new], len(self.places) - len(again) - len(new)):
                found[i] = at
        place = np.array(found, np.int64)
        flat, size = _rows(self.flat, self.begin, place, codes)
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return flat, ends


def _rows(flat: np.ndarray, begin: np.ndarray, places: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The integers at ``places`` (or at ``places[codes]``) end to end, and how many each has."""
    first, size = begin[places].astype(np.int32), (begin[places + 1] - begin[places]).astype(np.int32)
    if codes is not None:
        first, size = first[codes], size[codes]
    first -= np.cumsum(size, dtype=np.int32)
    first += size
    at = np.repeat(first, size)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], size
