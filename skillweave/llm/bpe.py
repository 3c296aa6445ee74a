"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  Each round finds the rank of every adjacent pair by binary search over
the sorted pair keys, takes the lowest rank of each word, merges that pair wherever it stands in the word (from the
left, without overlap) and drops finished words.  A piece of more than ``LONG`` symbols, for which rounds would be
quadratic, is merged with a heap instead: same rule, one merge at a time.

Decoding looks every id up in one flat table of token texts.

A null text is an empty one: no ids, empty decoded text.  Rows are independent, so repeated rows give repeated results.
Very long texts and very long words take time and memory in proportion to their length.  Other columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.pieces import PieceStore, byte_alphabet
from skillweave.llm.shared import slices, small_batches, text_buffers

LONG = 512
#: Bytes of text that are encoded at once, about, and chunks that a worker keeps: small, so that a worker stays small.
SLICE_BYTES, MOST_CHUNKS = 1_000_000, 100_000
NONE = np.int64(1) << 40


class Merges:
    """A vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        keep = np.concatenate([[True], np.diff(key[order]) != 0])
        self.key, self.rank = key[order][keep], order[keep].astype(np.int64)
        self.made = made
        letters = byte_alphabet()
        self.inner = {c: vocab[c] for c in letters}
        self.last = {c: vocab[c + self.end] for c in letters}
        self.text = {i: t for t, i in vocab.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def symbols(self, piece: str) -> list[int]:
        return [*map(self.inner.__getitem__, piece[:-1]), self.last[piece[-1]]]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece (text in the byte alphabet)."""
        out: list = [None] * len(pieces)
        short, flat, lengths = [], [], []
        for i, piece in enumerate(pieces):
            symbols = self.symbols(piece)
            if len(symbols) > LONG:
                out[i] = self._with_heap(symbols)
            elif len(symbols) == 1:
                out[i] = symbols
            else:
                short.append(i)
                flat += symbols
                lengths.append(len(symbols))
        if short:
            for i, ids in zip(short, self._rounds(np.array(flat, np.int64), np.array(lengths)), strict=True):
                out[i] = ids
        return out

    def _rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            per = np.diff(np.append(begin, len(word)))
            lowest = np.repeat(best, per)
            over = lowest == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, lowest = symbols[~over], word[~over], rank[~over], lowest[~over]
                if not len(symbols):
                    break
            hit = rank == lowest
            if (hit[1:] & hit[:-1]).any():  # a run of one symbol: every other pair, from the left
                at = np.flatnonzero(hit)
                run = np.cumsum(np.concatenate([[True], np.diff(at) != 1])) - 1
                first = at[np.concatenate([[True], np.diff(at) != 1])]
                hit[at[(at - first[run]) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        ids, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        cuts = np.cumsum(np.bincount(word, minlength=len(lengths)))
        flat, low, out = ids[order].tolist(), 0, []
        for high in cuts.tolist():
            out.append(flat[low:high])
            low = high
        return out

    def _with_heap(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        nxt, prv, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        all_ranks = self.ranks(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(all_ranks) if r < NONE]
        heapq.heapify(heap)
        known = {}

        def push(i: int) -> None:
            if i >= 0 and (j := nxt[i]) >= 0:
                pair = (symbols[i], symbols[j])
                if pair not in known:
                    known[pair] = int(self.ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] < NONE:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], nxt[i] = int(self.made[rank]), False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            push(prv[i])
            push(i)
        return [s for s, live in zip(symbols, alive, strict=True) if live]


class TokenTexts:
    """The text of every id, in one table; ids that the vocabulary doesn't have are skipped, as its library does."""

    def __init__(self, text: dict[int, str]):
        self.table = pa.array([text[i].encode() + b" " if i in text else b"" for i in range(max(text) + 1)] + [b""], pa.large_binary())

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all ids' texts, a space after each, and where each id's begin (n+1 entries)."""
        known = np.where(ids < len(self.table) - 1, ids, len(self.table) - 1)
        taken = self.table.take(pa.array(known.astype(np.int64)))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


class Codec:
    """Whole texts to ids and back, as the vocabulary's library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        tokenizer = Tokenizer.from_file(path)
        self.store = PieceStore(tokenizer, self.merges.encode, MOST_CHUNKS)
        self.texts = TokenTexts(self.merges.text | {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()})

    def encode(self, text: str | None) -> np.ndarray:
        return self.store.ids(*text_buffers(pa.array([text], pa.string())))[0].astype("<u4")

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Tokens joined by one space: the vocabulary has no decoder."""
        return self.texts.decode(np.asarray(ids, np.int64))[0].tobytes().decode()[:-1]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker and vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


#: What can be asked for of each document, and its type.
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def _columns(own: Codec, ids: np.ndarray, begin: np.ndarray, wanted: tuple[str, ...]) -> dict[str, pa.Array]:
    """The ``wanted`` outputs of documents whose ids begin at ``begin``; decoded texts come from the ids alone."""
    cuts = list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))
    out: dict[str, pa.Array] = {"n_tokens": pa.array(np.diff(begin), pa.int64())}
    if "ids" in wanted:
        out["ids"] = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
    if "ids_sha256" in wanted:
        raw = memoryview(ids.astype("<u4").view(np.uint8))
        out["ids_sha256"] = pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in cuts], pa.string())
    if "decoded" in wanted or "decoded_sha256" in wanted:
        data, at = own.texts.decode(ids)
        said = memoryview(data)
        ends = at[begin].tolist()
        bounds = [(a, max(a, b - 1)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if "decoded_sha256" in wanted:
            out["decoded_sha256"] = pa.array([hashlib.sha256(said[a:b]).hexdigest() for a, b in bounds], pa.string())
        if "decoded" in wanted:
            out["decoded"] = pa.array([bytes(said[a:b]).decode() for a, b in bounds], pa.string())
    return {name: out[name] for name in wanted}


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...]) -> DataFrame:
    """doc_id and the asked ``OUTPUTS`` for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                ids, begin = own.store.ids(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                made = _columns(own, ids, begin, outputs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made.values()], names=["doc_id", *made])

    small_batches(docs.sparkSession)
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *[f"{name} {OUTPUTS[name]}" for name in outputs]])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row of ``docs`` (doc_id, text)."""
    return encode(docs, path, ("ids", "decoded"))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, without moving either."""
    return encode(docs, path, ("n_tokens", "ids_sha256", "decoded_sha256"))
