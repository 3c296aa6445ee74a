"""What several operators need: the shared folder, materialised tables, Arrow text buffers, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word rules of these operators see it.
SPACES = (0x20, *range(0x09, 0x0E))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session has none (tests, a single machine) one is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jvm_dir.get() if jvm_dir.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="skillweave-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Rows and bytes of an Arrow batch at most, where rows hold whole texts (a longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what the session hands Python at once.

    Spark reads these two settings when a plan runs, so they can't be given to one operator: every operator of this
    subpackage that runs Python asks for the same bounds, and smaller ones of the session stay.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        number = int(now.rstrip("b"))
        if number <= 0 or number > most:
            spark.conf.set(key, str(most))


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, cut the lineage: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


class Scratch:
    """Tables of one operator in the shared folder, by name; each is dropped as soon as nothing reads it any more.

    A table is written before the next step is planned, so dropping it never breaks the recovery of a later one.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
        """Write and read back; an older table of that name goes after the new one is there.

        ``group_rows`` bounds the rows of a Parquet row group, which is what a task holds at once, where rows are large.
        """
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.options(**({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column, end to end, and their n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 2_000_000):
    """Runs [i, j) of rows whose texts have about ``limit`` bytes together; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), so that close inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of the words of UTF-8 texts, with numpy only.

    ``word_byte`` says which bytes belong to words.  A-Z count as a-z.  A word's bytes go in blocks of eight through
    ``mix``, which no product or sum of bytes can predict; words of up to eight bytes and one length never collide.
    Words of over ``LONG`` bytes are digested whole.
    """

    LONG = 64

    def __init__(self, word_byte: np.ndarray):
        self.word = word_byte.astype(bool)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    @classmethod
    def split_on_spaces(cls) -> WordHasher:
        word = np.ones(256, bool)
        word[list(SPACES)] = False
        return cls(word)

    @classmethod
    def letters_and_digits(cls) -> WordHasher:
        """ASCII letters and digits, and every byte of a character beyond ASCII."""
        word = np.zeros(256, bool)
        word[48:58] = word[65:91] = word[97:123] = word[128:] = True
        return cls(word)

    def spans(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words; no word crosses one of ``breaks`` (the texts' offsets)."""
        inside = self.word[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        if len(raw):
            edge[0], edge[-1] = inside[0], inside[-1]
        at = np.flatnonzero(edge)
        cut = breaks[(breaks > 0) & (breaks < len(raw))]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]])
        if len(cut):
            at = np.sort(np.concatenate([at, cut, cut]))
        return at[::2], at[1::2]

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low = np.zeros(len(raw) + 8, np.uint8)
        low[: len(raw)] = self.lower[raw]
        eight = np.ndarray((len(raw) + 1,), "<u8", low, strides=(1,))  # the eight bytes from each place on
        size = ends - starts
        with np.errstate(over="ignore"):
            out = mix(size.astype(np.uint64) + np.uint64(0xA24BAED4963EE407))
            live, left = np.arange(len(starts)), np.minimum(size, self.LONG)
            for at in range(0, self.LONG, 8):
                block = eight[starts[live] + at] & _FIRST_BYTES[np.minimum(left - at, 8)]
                out[live] = mix(out[live] ^ block)
                longer = left > at + 8
                live, left = live[longer], left[longer]
                if not len(live):
                    break
        for k in np.flatnonzero(size > self.LONG).tolist():
            out[k] = int.from_bytes(blake2b(low[starts[k] : ends[k]], digest_size=8).digest(), "little")
        return out


#: Masks that keep the first 0 to 8 bytes of a block.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_of(hasher: WordHasher, raw: np.ndarray, offsets: np.ndarray):
    """Hash of every word, in order, and for each text its first word's index (n+1 entries)."""
    starts, ends = hasher.spans(raw, offsets)
    return hasher.hashes(raw, starts, ends), np.searchsorted(starts, offsets, "left")


#: Ids that are broadcast at most (32 MB); more are met in a shuffled join.
MOST_IDS = 4_000_000


def _met(ids: DataFrame, most: int) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= most else ids


def rows_in(df: DataFrame, ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """Rows of ``df`` whose doc_id is in ``ids`` (doc_id, a stored table).  Few enough ids are broadcast, so that texts stay where they are."""
    return df.join(_met(ids, most), "doc_id", "left_semi").select(df.columns)


def rows_not_in(df: DataFrame, ids: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """Rows of ``df`` whose doc_id isn't in ``ids``; rows without doc_id stay."""
    return df.join(_met(ids, most), "doc_id", "left_anti").select(df.columns)
