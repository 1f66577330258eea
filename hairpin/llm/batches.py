"""Arrow batches of texts as numpy arrays: words, word hashes and byte slices for a few MB of text at a time.

Everything here is a helper for tasks that Spark partitions: a task sees a bounded slice of its
partition (``SLICE_BYTES`` of text or one longer document), never the partition as a whole.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a task turns into arrays at once; arrays of a word a byte then stay within a processor's cache.
SLICE_BYTES = 512 << 10
#: Rows of an Arrow batch; long documents make larger rows, hence few of them.
ROWS_PER_BATCH = 512

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a hash base and of its inverse; those that a longer document asked for are given back with the task's memory."""

    kept = SLICE_BYTES + 1

    def __init__(self, base: int):
        self.base, self.up = base, np.zeros(0, _U)

    def at_least(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, self.kept)
            self.up, self.down = _powers(self.base, n), _powers(pow(self.base, -1, 1 << 64), n)

    def shrink(self) -> None:
        if len(self.up) > self.kept:
            self.up, self.down = self.up[: self.kept].copy(), self.down[: self.kept].copy()


#: The usual base of hashes, and another where two independent ones are asked for.
BASE, OTHER_BASE = _Powers(int(_MULT)), _Powers(0xD6E8FEB86659FD93)


def prefix_hash(data: np.ndarray, base: _Powers = BASE) -> np.ndarray:
    """P with len(data) + 1 entries; see :func:`range_hash`."""
    base.at_least(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * base.up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: _Powers = BASE) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * base.down[start] + (end - start).astype(_U))


#: From this length on, bytes are hashed as they are. Sums of powers modulo 2^64 have collisions by construction, whatever the base, which
#: take some thousand bytes.
LONG_SPAN = 512


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: _Powers = BASE) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes. Those of long spans are BLAKE2 digests."""
    h = range_hash(prefix_hash(data, base), start, end, base)
    for i in np.flatnonzero(end - start >= LONG_SPAN).tolist():
        own = data[start[i] : end[i]].tobytes()
        h[i] = int.from_bytes(blake2b(own, digest_size=8, salt=base.base.to_bytes(8, "little")).digest(), "little")
    return h


def with_fields(schema: StructType, more: str) -> StructType:
    """``schema`` with further fields: no name is quoted, so any name will do."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def map_texts(docs: DataFrame, text: str, more: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` with the fields ``more``, which replace columns so named. ``run`` takes batches of (row, text) and gives (row, fields): the columns
    travel as one, so that their names, dots in them included, are in nobody's way."""
    new = StructType.fromDDL(more)
    columns = [c for c in docs.columns if c not in new.names]
    packed = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in columns]).alias("row"), F.col(quoted(text)).alias("text"))
    out = packed.mapInArrow(run, with_fields(StructType([packed.schema["row"]]), more))
    return out.select(*[F.col("row")[c].alias(c) for c in columns], *new.names)


@dataclass
class Texts:
    """Consecutive documents: their bytes and the n + 1 offsets between them."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lowered(self) -> Texts:
        """A-Z in lower case; other bytes stay."""
        return Texts(_LOWER[self.data], self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first) of the words: runs of bytes other than space and 09-0D that don't cross
        documents; first[i] is the number of words before document i, with the total at the end."""
        solid = ~_SPACE[self.data]
        n = len(solid)
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        cut = self.offsets[1:-1]
        cut = cut[(cut < n) & (cut > 0)]
        begins[cut] |= solid[cut]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        ends[cut - 1] |= solid[cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, self.offsets)


def texts_of(column: pa.Array) -> Texts:
    """A string column; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return Texts(data, offsets - offsets[0])


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and hold what they once needed."""
    BASE.shrink()
    OTHER_BASE.shrink()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of each batch with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            off = whole.offsets[at : to + 1]
            yield batch.slice(at, to - at), Texts(whole.data[off[0] : off[-1]], off - off[0])
            at = to
    give_back()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_rows(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bounds the Arrow batches of this session: documents can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Like :func:`arrow_rows` for what is run within; the session's setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    arrow_rows(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_out(doc_id: str, folds: int, fold: int = 0):
    """True where crc32(doc_id as text) mod folds is fold; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))
