"""Token-id files with Re-Pair grammar compression.

Documents are dealt into shards by ascending doc_id.  In each shard frequent id pairs are replaced by new symbols, again
and again, until no pair of symbols occurs ``LEAST_COUNT`` times without overlap; a file holds the rules, the length that
every rule expands to, and each document's place among the symbols, so that one document, or any range of ids, is decoded
without the rest.  No pair crosses the end of a document.  Shard files are rows of a table of binary payloads in the
shared folder, so that any executor reads and writes them where Spark does.

A round replaces all frequent pairs at once, the more frequent first where two overlap.  A pair of old symbols can't become
more frequent, so the next round looks only at pairs beside a new symbol and at frequent ones that lost a place: symbols
are a linked list, and after the first rounds few places are looked at.

Layout (little-endian): magic ``SWRP3``, then as unsigned 32-bit integers the numbers of distinct ids, rules, documents,
documents without doc_id (they come first) and symbols; the distinct ids in rising order (symbols below their number are
places among them, the others are rules), the rules' expansion lengths, the documents' first symbols (one more than
documents), their first ids (the same), the doc_ids as signed 64-bit integers, the rules (two symbols each) and the
symbols (16 bits if all numbers fit).

doc_id is a number (any type that casts to bigint).  A null text is an empty one: its document is the end id alone.
Repeated rows are kept, ordered by (doc_id, text).  A null doc_id sorts first.  A document longer than a shard is a shard
of its own.  Other columns are ignored.  An empty table makes no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.pieces import PieceStore
from skillweave.llm.shared import slices, small_batches, text_buffers, write_table

MAGIC = b"SWRP3"
END_ID = 2
SHARD_IDS = 1 << 20
LEAST_COUNT = 8
SLICE_BYTES = 4_000_000


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct piece that isn't held."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # Pieces come normalised, split and in the byte alphabet: only the merges are left to the library.
        merge = tokenizer.model.tokenize
        self.store = PieceStore(tokenizer, lambda pieces: [[t.id for t in merge(p)] for p in pieces])

    def ids(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, ``end_id`` after each, and where each text's begin (n+1 entries)."""
        flat, begin = self.store.ids(raw, offsets)
        n = len(begin) - 1
        out = np.empty(len(flat) + n, np.uint32)
        whole = begin + np.arange(n + 1)
        ends = whole[1:] - 1
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside], out[ends] = flat, end_id
        return out, whole


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


FAR = np.int32(np.iinfo(np.int32).max)
TAKEN = np.int32(-1)


class Symbols:
    """A shard's symbols as a linked list; ``n`` stands for no neighbour."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = self.n = len(ids)
        self.at = ids.astype(np.int32)
        self.next, self.before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        filled = np.diff(first) > 0
        self.next[first[1:][filled] - 1] = n
        self.next[n] = n
        self.before[first[:-1][filled]] = n
        self.alive = np.ones(n + 1, bool)
        self.alive[n] = False
        self.level = np.full(n + 1, FAR, np.int32)

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs and their keys, without every other pair of a run of one symbol; and the places left out."""
        left, right = self.at[at], self.at[self.next[at]]
        key = (left.astype(np.int64) << 32) | right
        twins = np.flatnonzero(left == right)
        if len(twins):
            follows = np.zeros(len(twins), bool)
            follows[1:] = (self.next[at[twins[:-1]]] == at[twins[1:]]) & (key[twins[1:]] == key[twins[:-1]])
            begin = np.flatnonzero(~follows)
            place = np.arange(len(twins)) - np.repeat(begin, np.diff(np.append(begin, len(twins))))
            keep = np.ones(len(at), bool)
            keep[twins[place % 2 == 1]] = False
            return at[keep], key[keep], at[~keep]
        return at, key, at[:0]

    def winners(self, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are replaced: where two overlap, the one of lower rank."""
        level, won, ranks, asked = self.level, [], [], at
        level[at] = rank
        while len(at):
            first = (rank < level[self.before[at]]) & (rank < level[self.next[at]])
            w = at[first]
            won.append(w)
            ranks.append(rank[first])
            level[self.next[w]] = FAR
            beaten = self.before[w]
            level[beaten[level[beaten] != TAKEN]] = FAR
            level[w] = FAR
            level[self.n] = FAR
            open_ = level[at] != FAR
            at, rank = at[open_], rank[open_]
        level[asked] = FAR
        return np.concatenate(won), np.concatenate(ranks)

    def replace(self, at: np.ndarray, symbols: np.ndarray) -> None:
        gone = self.next[at]
        after = self.next[gone]
        self.alive[gone] = False
        self.at[at] = symbols
        self.next[at] = after
        self.before[after] = at
        self.next[self.n] = self.n


def _frequent(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur at least ``LEAST_COUNT`` times, the most frequent first, and where: places and ranks."""
    if len(key) > 1 << 16:  # most keys are rare: a count by hash leaves them out
        bucket = (key * np.int64(-7046029254386353131) >> np.int64(44)) & np.int64((1 << 20) - 1)
        heavy = (np.bincount(bucket, minlength=1 << 20) >= LEAST_COUNT)[bucket]
        at, key = at[heavy], key[heavy]
    coded = pa.array(key).dictionary_encode()
    codes, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    counts = np.bincount(codes, minlength=len(pairs))
    often = np.flatnonzero(counts >= LEAST_COUNT)
    order = often[np.lexsort((pairs[often], -counts[often]))]
    rank = np.full(len(pairs), FAR, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    own = rank[codes]
    return pairs[order], at[own != FAR], own[own != FAR]


def compress(ids: np.ndarray, first: np.ndarray, rounds: int | None = None):
    """Rules, expansion lengths, symbols and each document's first symbol for ``ids`` (documents start at ``first``).

    Without ``rounds`` it goes on until no pair is frequent.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    own = Symbols(ids, first)
    at = np.flatnonzero(own.next[: own.n] != own.n).astype(np.int32)
    rules, lengths, done = [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64), 0
    while len(at) and (rounds is None or done < rounds):
        done += 1
        at, key, others = own.pairs(at)
        pairs, frequent, rank = _frequent(at, key)
        if not len(pairs):
            break
        won, of = own.winners(frequent, rank)
        used = np.bincount(of, minlength=len(pairs)) >= LEAST_COUNT  # true of the most frequent pair
        number = (base + len(lengths) + np.cumsum(used) - 1).astype(np.int32)
        won, of = won[used[of]], of[used[of]]
        made = np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1)
        known = np.concatenate([[1], lengths])
        lengths = np.concatenate([lengths, known[np.maximum(made - base + 1, 0)].sum(1)])
        rules.append(made)
        own.replace(won, number[of])
        look = np.zeros(own.n + 1, bool)
        look[frequent] = look[others] = look[won] = look[own.before[won]] = True
        look &= own.alive & (own.next != own.n)
        at = np.flatnonzero(look).astype(np.int32)
    place = np.concatenate([[0], np.cumsum(own.alive[: own.n])])
    return base, np.concatenate(rules), lengths, own.at[own.alive[:-1] if own.n else []], place[first]


def _symbol_type(base: int, rules: int) -> str:
    return "<u2" if base + rules <= 1 << 16 else "<u4"


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in rising order, and each id's place among them."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    met = np.bincount(ids) > 0
    return np.flatnonzero(met), (np.cumsum(met, dtype=np.int32) - 1)[ids]


def pack_ids(doc_ids: list, ids: np.ndarray, starts: np.ndarray) -> bytes:
    """One shard file of documents whose ids begin at ``starts`` (n+1 entries); documents without doc_id come first."""
    alphabet, places = _places(ids)
    base, rules, lengths, symbols, first = compress(places, starts)
    kind = _symbol_type(base, len(rules))
    nameless = sum(d is None for d in doc_ids)
    head = MAGIC + struct.pack("<5I", base, len(rules), len(doc_ids), nameless, len(symbols))
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [alphabet.astype("<u4"), lengths.astype("<u4"), first.astype("<u4"), starts.astype("<u4"), names, rules.astype(kind), symbols.astype(kind)]
    return head + b"".join([p.tobytes() for p in parts])


def pack(doc_ids: list, ids: list[bytes]) -> bytes:
    """One shard file of documents given as unsigned 32-bit ids."""
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
    return pack_ids(doc_ids, np.frombuffer(b"".join(ids), "<u4"), starts)


class File:
    """Random access to a shard file."""

    def __init__(self, payload: bytes):
        if payload[:5] != MAGIC:
            raise ValueError("not a token-id file")
        self.base, n_rules, n_docs, self.nameless, n_symbols = struct.unpack_from("<5I", payload, 5)
        at = 25

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        kind = _symbol_type(self.base, n_rules)
        self.alphabet = take("<u4", self.base)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.first, self.starts = take("<u4", n_docs + 1).astype(np.int64), take("<u4", n_docs + 1).astype(np.int64)
        self.doc_ids = take("<i8", n_docs)
        self.rules = take(kind, 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.symbols = take(kind, n_symbols)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        symbols = symbols.astype(np.int64)
        while len(symbols) and (at := symbols >= self.base).any():
            size = np.where(at, 2, 1)
            place = np.cumsum(size) - size
            out = np.empty(int(size.sum()), np.int64)
            out[place[~at]] = symbols[~at]
            pair = self.rules[symbols[at] - self.base]
            out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return self.alphabet[symbols]

    def whole(self) -> np.ndarray:
        """All ids of the shard: every rule is expanded once, then the symbols' expansions are laid end to end."""
        size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        flat[: self.base] = self.alphabet
        todo = np.arange(len(self.rules))
        ready = np.concatenate([np.ones(self.base, bool), np.zeros(len(self.rules), bool)])
        while len(todo):  # as many turns as rules are deep
            now = ready[self.rules[todo]].all(1)
            for side in (0, 1):
                part = self.rules[todo[now], side]
                to = begin[todo[now] + self.base] + (size[self.rules[todo[now], 0]] if side else 0)
                within = _ranges(size[part])
                flat[np.repeat(to, size[part]) + within] = flat[np.repeat(begin[part], size[part]) + within]
            ready[todo[now] + self.base] = True
            todo = todo[~now]
        symbols = self.symbols.astype(np.int64)
        n = size[symbols]
        at = np.repeat(begin[symbols] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return flat[at]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[k] : self.first[k + 1]])

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard, decoding only the symbols that cover them."""
        symbols = self.symbols.astype(np.int64)
        size = np.where(symbols < self.base, 1, self.lengths[np.maximum(symbols - self.base, 0)] if len(self.lengths) else 1)
        ends = np.cumsum(size)
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left") + 1
        before = int(ends[low - 1]) if low else 0
        return self.expand(symbols[low:high])[start - before : start - before + n]


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... below each size, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def write_files(docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The stored table of shard files: part, shard (both ascending with doc_id), n_docs, n_ids, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, own = TaskContext.get().partitionId(), 0, encoder(path)
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, sizes, total, shard
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            payload = pack_ids(names, np.concatenate(held), starts)
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([total], pa.int64()), pa.array([payload], pa.binary())]
            names, held, sizes, total, shard = [], [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "n_docs", "n_ids", "payload"])

        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in slices(offsets, SLICE_BYTES):
                ids, begin = own.ids(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
                k = 0
                while k < j - i:  # as many documents as fill the shard
                    upto = min(j - i, int(np.searchsorted(begin, begin[k] + shard_ids - total, "left")))
                    upto = max(upto, k + 1)
                    names += doc_ids[i + k : i + upto]
                    held.append(ids[begin[k] : begin[upto]])
                    sizes += np.diff(begin[k : upto + 1]).tolist()
                    total += int(begin[upto] - begin[k])
                    k = upto
                    if total >= shard_ids:
                        yield flush()
        if names:
            yield flush()

    small_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return write_table(ordered.mapInArrow(run, "part int, shard int, n_docs bigint, n_ids bigint, payload binary"), "tokens")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of every document, decoded from the files.

    The ids before a shard come from two sums: over the parts, of which there are as many as partitions, and inside a part.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    offsets = files.select("part", "shard", "n_ids").withColumn("inside", inside).join(parts, "part").select("part", "shard", (F.col("before_part") + F.col("inside")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                file = File(payload.as_py())
                raw = memoryview(file.whole().astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(file.starts[:-1].tolist(), file.starts[1:].tolist(), strict=True)]
                n = len(crc)
                columns = [
                    pa.array([part.as_py()] * n, pa.int32()),
                    pa.array([shard.as_py()] * n, pa.int32()),
                    pa.array(file.doc_ids, pa.int64(), mask=np.arange(n) < file.nameless),
                    pa.array(file.starts[:-1], pa.int64()),
                    pa.array(np.diff(file.starts), pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = files.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(offsets, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
