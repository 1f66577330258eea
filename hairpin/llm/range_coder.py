"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block is BLOCK ids. Its models begin empty, so a block is read without any other; its CRC-32 tells whether it was read right. The
blocks of a segment are coded in step, one numpy lane each.

Three models give each id a probability. Order 0 counts classes of ids (class k has the ids from k^2 to (k+1)^2 - 1, as ids of low
number are frequent), whose shares are worked out anew from time to time. Order 1 and order 2 guess the id that last followed
the same one or two ids, with a probability that adapts to how often guesses of that standing were right, and leave the rest to order
0. The id is coded once, by the mixture of the three probabilities; a model's weight is multiplied by the probability that it gave to what
came, against that of the mixture, and a small share of all weights is dealt out evenly. Sums and products of single
floating-point numbers and integers are the same everywhere, so the reader repeats the writer's steps exactly.

Files are Parquet tables of segments, written and read by Spark: one row has the document ids and lengths, the blocks' sizes and check
sums and the coded words. Rows are in ascending order of doc_id over the parts, as (part, segment) tell.

Defined results: a null or empty text is one id, the end; long documents cross blocks; repeated rows are written each; null doc_ids come first;
an empty table makes an empty table; other columns aren't written. Ids are below 2^20. A damaged block raises ValueError.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hairpin.llm.batches import arrow_rows, rows_per_batch, slices
from hairpin.llm.bpe import coder
from hairpin.plans.lineage import discard, shared_folder, store

BLOCK = 2048
#: Lanes of a segment; with BLOCK the ids that a task holds at once, but for one longer document.
LANES = 4096
#: The id that ends a document.
END = 1
#: Contexts that an order remembers in a block.
SLOTS = 512
#: Counts of order 0: of a class at first, and what each id adds; its shares are worked out after these many ids, and after each AGAIN.
FIRST_COUNT, RAISE, EARLY, AGAIN = 1, 8, (16, 32, 64), 128
#: Steps of a guess's probability and of the weights towards what came, and the most that a guess is given.
RATE, SHARE, MOST = np.float32(1 / 16), np.float32(1 / 50), np.float32(0.96)
_U, _I, _F = np.uint64, np.int64, np.float32
#: Bits of the mixture's total, and of a word of the code.
_TOTAL, _WORD = 31, _U(32)
_CELL = _U(1 << 32)
_LOW = _CELL - _U(1)
#: A guess's standing after a miss (first half) and after a hit; from a standing of 4 on a guess survives a miss.
_STANDING = np.array([*(c >> 1 for c in range(16)), *(min(c + 1, 15) for c in range(16))], np.int32)
_SURVIVES = 4


def class_of(ids: np.ndarray) -> np.ndarray:
    """The whole part of the square root."""
    return np.sqrt(ids).astype(_I)


class Order:
    """Guesses by a hash of the last ids, with the probability that one of its standing is right."""

    def __init__(self, n: int):
        # a guess, and its standing in the last four bits
        self.table, self.chance = np.zeros(n * SLOTS, np.int32), np.full(n * 16, 0.3, _F)
        self.slots, self.cells = np.arange(n) * SLOTS, np.arange(n) * 16

    def look(self, m: int, context: np.ndarray) -> None:
        self.slot = self.slots[:m] + (context & (SLOTS - 1))
        entry = self.table.take(self.slot, mode="clip")
        self.guess, self.standing = entry >> 4, entry & 15
        self.cell = self.cells[:m] + self.standing
        self.p = self.chance.take(self.cell, mode="clip")

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        self.chance[self.cell] = self.p + (hit * MOST - self.p) * RATE
        kept = np.where(hit | (self.standing >= _SURVIVES), self.guess, ids)
        self.table[self.slot] = (kept << 4) | _STANDING.take(self.standing + (hit << 4), mode="clip")


class Model:
    """Predictions and their updates for n blocks in step; ids are below ``size``."""

    def __init__(self, n: int, size: int):
        self.most = size - 1
        self.classes = int(class_of(np.array(self.most, np.int64))) + 1
        self.one, self.two = Order(n), Order(n)
        self.count = np.full((n, self.classes), FIRST_COUNT, np.int32)
        self.width, self.row = 2 * np.arange(self.classes, dtype=np.int32) + 1, np.arange(n) * self.classes
        self.weight = [np.full(n, 1 / 3, _F) for _ in range(3)]
        self.last1, self.last2, self.seen = np.zeros(n, _I), np.zeros(n, _I), []
        self._share()

    def _share(self) -> None:
        """Order 0's share of each id of a class, and of all ids below the class, by what has come so far."""
        if self.seen:
            self.count += RAISE * np.bincount(np.concatenate(self.seen), minlength=self.count.size).astype(np.int32).reshape(self.count.shape)
            self.seen = []
        scale = (1 << 20) / self.count.sum(1)
        unit = (self.count * scale[:, None] / self.width).astype(np.int32) + 1
        own = unit * self.width
        ends = np.cumsum(own, axis=1, dtype=np.int32)
        self.total = ends[:, -1].astype(np.float64)
        # what is below in the upper half of a number, the share in the lower
        self.shares = ((ends - own).astype(_I) << 32 | unit).ravel()

    def _shares(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.shares.take(at, mode="clip")
        return both >> 32, both & 0xFFFFFFFF

    def predict(self, t: int, m: int) -> None:
        """The mixture for the next id of the first m lanes: the masses of the two guesses and of a unit of order 0."""
        if t in EARLY or (t and t % AGAIN == 0):
            self._share()
        mixed = self.last1[:m] * 40503
        self.one.look(m, mixed >> 4)
        self.two.look(m, (mixed + self.last2[:m] * 30011) >> 5)
        whole = _F(1 << _TOTAL)
        self.mass1, self.mass2 = (self.weight[1][:m] * self.one.p * whole).astype(_I), (self.weight[2][:m] * self.two.p * whole).astype(_I)
        self.each = (((1 << _TOTAL) - self.mass1 - self.mass2) / self.total[:m]).astype(_I)

    def interval(self, m: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids in the mixture."""
        of = class_of(ids)
        self.at = self.row[:m] + of
        below, self.own = self._shares(self.at)
        self.hit1, self.hit2 = self.one.guess == ids, self.two.guess == ids
        start = self.each * (below + (ids - of * of) * self.own) + self.mass1 * (self.one.guess < ids) + self.mass2 * (self.two.guess < ids)
        return start, self.each * self.own + self.mass1 * self.hit1 + self.mass2 * self.hit2

    def find(self, m: int, value: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold these values."""
        one, two = self.one.guess, self.two.guess

        def bounds(guess: np.ndarray, mass: np.ndarray, other: np.ndarray, other_mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of = class_of(guess)
            below, unit = self._shares(self.row[:m] + of)
            start = self.each * (below + (guess - of * of) * unit) + other_mass * (other < guess)
            return start, start + self.each * unit + mass + other_mass * (other == guess)

        start1, end1 = bounds(one, self.mass1, two, self.mass2)
        start2, end2 = bounds(two, self.mass2, one, self.mass1)
        in1, above1, above2 = (value >= start1) & (value < end1), value >= end1, value >= end2
        ids = np.where(in1, one, two).astype(_I)
        rest = np.flatnonzero(~(in1 | ((value >= start2) & ~above2)))
        if len(rest):
            # without the masses of the guesses below, order 0 alone tells the class, by bisection
            left = value[rest] - self.mass1[rest] * above1[rest] - self.mass2[rest] * above2[rest]
            place = np.minimum(left / self.each[rest], self.total[rest] - 1).astype(_I)
            row, of, key = self.row[rest], np.zeros(len(rest), _I), place << 32 | 0xFFFFFFFF
            for bit in reversed(range(self.classes.bit_length())):
                on = of + (1 << bit)
                fits = (on < self.classes) & (self.shares.take(row + on, mode="clip") <= key)
                of = np.where(fits, on, of)
            below, unit = self._shares(row + of)
            ids[rest] = np.minimum(of * of + ((place - below) / unit).astype(_I), self.most)
        return ids

    def learn(self, m: int, ids: np.ndarray) -> None:
        """Takes in what came; :meth:`interval` has placed it."""
        zero = (self.own / self.total[:m]).astype(_F)
        w0, w1, w2 = (w[:m] for w in self.weight)
        p1, p2 = self.one.p, self.two.p
        g0, g1, g2 = w0 * zero, w1 * (p1 * self.hit1 + (1 - p1) * zero), w2 * (p2 * self.hit2 + (1 - p2) * zero)
        rest, even = (1 - SHARE) / (g0 + g1 + g2), SHARE / _F(3)
        w0[:], w1[:], w2[:] = g0 * rest + even, g1 * rest + even, g2 * rest + even
        self.one.learn(self.hit1, ids)
        self.two.learn(self.hit2, ids)
        self.seen.append(self.at)
        self.last2[:m] = self.last1[:m]
        self.last1[:m] = ids


class Writer:
    """Range coders in step. The code of a lane is below ``low + range``; when the range is under a word's, the word above it is settled."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)
        self.lanes: list[np.ndarray] = []
        self.words: list[np.ndarray] = []

    def put(self, m: int, start: np.ndarray, size: np.ndarray) -> None:
        low, span = self.low[:m], self.range[:m]
        unit = span >> _U(_TOTAL)
        low += start.astype(_U) * unit
        np.multiply(size.astype(_U), unit, out=span)
        at = np.flatnonzero(span < _CELL)
        if len(at):
            old = low[at]
            self.lanes.append(at.astype(np.int32))
            self.words.append((old >> _WORD).astype(np.uint32))
            # a range that would reach into the next word is cut off there
            span[at] = np.minimum(span[at], _CELL - (old & _LOW)) << _WORD
            low[at] = old << _WORD

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all lanes, one lane after the other; the number of each)."""
        n = len(self.low)
        for shift in (32, 0):
            self.lanes.append(np.arange(n, dtype=np.int32))
            self.words.append((self.low >> _U(shift) & _LOW).astype(np.uint32))
        lane, word = np.concatenate(self.lanes), np.concatenate(self.words)
        return word[np.argsort(lane.astype(np.uint16) if n <= 1 << 16 else lane, kind="stable")], np.bincount(lane, minlength=n)


class Reader:
    def __init__(self, words: np.ndarray, counts: np.ndarray):
        n = len(counts)
        self.words = np.concatenate([words, np.zeros(2, np.uint32)]).astype(_U)
        self.at = np.cumsum(counts) - counts
        self.low, self.range = np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)
        self.code = self.words[self.at] << _WORD | self.words[self.at + 1]
        self.at += 2

    def value(self, m: int) -> np.ndarray:
        """Where in the total the code of each lane stands."""
        self.unit = self.range[:m] >> _U(_TOTAL)
        return np.minimum((self.code[:m] - self.low[:m]) // self.unit, _U((1 << _TOTAL) - 1)).astype(_I)

    def take(self, m: int, start: np.ndarray, size: np.ndarray) -> None:
        low, span = self.low[:m], self.range[:m]
        low += start.astype(_U) * self.unit
        np.multiply(size.astype(_U), self.unit, out=span)
        at = np.flatnonzero(span < _CELL)
        if len(at):
            old = low[at]
            span[at] = np.minimum(span[at], _CELL - (old & _LOW)) << _WORD
            low[at] = old << _WORD
            place = self.at[at]
            self.code[at] = self.code[at] << _WORD | self.words.take(place, mode="clip")
            self.at[at] = place + 1


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of consecutive blocks of ids below ``size``; lengths don't rise."""
    n, most = len(lengths), int(lengths.max(initial=0))
    model, out = Model(n, size), Writer(n)
    # one row for each step
    table = np.zeros((n, most), np.int32)
    table[np.arange(most) < lengths[:, None]] = ids
    table = np.ascontiguousarray(table.T)
    for t in range(most):
        m = int(np.searchsorted(-lengths, -t, "left"))  # the lanes that still go on
        now = table[t, :m].astype(_I)
        model.predict(t, m)
        out.put(m, *model.interval(m, now))
        model.learn(m, now)
    return out.end()


def decode_blocks(words: np.ndarray, counts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    n, most = len(lengths), int(lengths.max(initial=0))
    model, code = Model(n, size), Reader(words, counts)
    table = np.zeros((most, n), np.int32)
    for t in range(most):
        m = int(np.searchsorted(-lengths, -t, "left"))
        model.predict(t, m)
        now = model.find(m, code.value(m))
        code.take(m, *model.interval(m, now))
        model.learn(m, now)
        table[t, :m] = now
    return table.T[np.arange(most) < lengths[:, None]]


def _checksums(ids: np.ndarray, lengths: np.ndarray) -> list[int]:
    raw, at = memoryview(ids.astype("<u4")).cast("B"), 0
    sums = []
    for n in lengths.tolist():
        sums.append(zlib.crc32(raw[at : at + 4 * n]))
        at += 4 * n
    return sums


_SCHEMA = "part int, segment int, doc_ids binary, doc_lengths binary, n_ids long, block_words binary, block_crc32 binary, vocabulary int, words binary"


def write(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every text, appends END and writes the ids in ascending order of doc_id."""
    arrow_rows(docs.sparkSession)
    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, segment = coder(tokenizer), TaskContext.get().partitionId(), 0
        size = len(c.vocabulary.strings)
        names, parts, sizes, have = [], [], [], 0
        z = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            nonlocal segment
            ids, docs_of = np.concatenate(parts), pa.concat_arrays(names)
            n = len(ids)
            lengths = np.full(-(-n // BLOCK), BLOCK)
            lengths[-1] = n - BLOCK * (len(lengths) - 1)
            words, counts = encode_blocks(ids, lengths, size)
            own = docs_of.fill_null(np.iinfo(np.int64).min).to_numpy()
            cols = [z.compress(own.tobytes()), z.compress(np.concatenate(sizes).astype(np.int64).tobytes()), n, counts.astype(np.uint32).tobytes(), np.array(_checksums(ids, lengths), np.uint32).tobytes(), size, words.tobytes()]
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            segment += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), *[pa.array([x], k) for x, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        for batch, texts in slices(batches, text):
            ids, first = c.encode(texts)
            ids, own = np.insert(ids, first[1:], END), np.diff(first) + 1
            if have and have + len(ids) > LANES * BLOCK:
                yield flush()
                names, parts, sizes, have = [], [], [], 0
            names.append(batch.column("doc_id"))
            parts.append(ids)
            sizes.append(own)
            have += len(ids)
        if have:
            yield flush()

    ordered.mapInArrow(run, _SCHEMA).write.option("compression", "none").parquet(path)


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, with its ids if asked for. A segment is a large row: run this
    with few rows a batch, see :func:`round_trip`."""
    table = spark.read.schema(_SCHEMA).parquet(path)
    sizes = table.select("part", "segment", "n_ids")
    # sums by part, then over parts, then over the segments of a part: no task gets all segments
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    starts = sizes.select("part", "segment", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("before")).join(parts, "part").select("part", "segment", (F.col("before") + F.col("before_part")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, segment, doc_ids, doc_lengths, n, counts, sums, vocabulary, words = (batch.column(x)[i].as_py() for x in ("part", "segment", "doc_ids", "doc_lengths", "n_ids", "block_words", "block_crc32", "vocabulary", "words"))
                lengths = np.full(-(-n // BLOCK), BLOCK)
                lengths[-1] = n - BLOCK * (len(lengths) - 1)
                ids = decode_blocks(np.frombuffer(words, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64), lengths, vocabulary)
                if _checksums(ids, lengths) != np.frombuffer(sums, np.uint32).tolist():
                    raise ValueError(f"a block of part {part}, segment {segment} is damaged")
                own = np.frombuffer(zstandard.decompress(doc_ids), np.int64)
                size = np.frombuffer(zstandard.decompress(doc_lengths), np.int64)
                null = own == np.iinfo(np.int64).min
                cols = [pa.array(np.full(len(own), part, np.int32)), pa.array(np.full(len(own), segment, np.int32)), pa.array(own, mask=null), pa.array(np.cumsum(size) - size), pa.array(size), pa.array(_checksums(ids, size), pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    extra = ["ids"] if with_ids else []
    found = table.mapInArrow(run, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return found.join(starts, ["part", "segment"]).select("doc_id", (F.col("at") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *extra)


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes the files and reads them back; those in the shared folder, unless a path is given, are deleted then."""
    spark = docs.sparkSession
    at = path or f"{shared_folder(spark)}/hairpin-{uuid.uuid4().hex}"
    write(docs, tokenizer, at, doc_id, text)
    with rows_per_batch(spark, 1):
        out = store(read(spark, at))
    if not path:
        discard(spark.read.parquet(at))
    return out.withColumnRenamed("doc_id", doc_id)
