"""Lexical retrieval packing: windows filled with a seed document and its nearest unused neighbours by BM25.

Texts are encoded once and their ids stored. Document frequencies and the mean length are of the whole corpus (a count for each
id of the vocabulary). The inverted index is sharded by content: documents are dealt out in the order of their two heaviest terms, so
that those which share them stand together wherever they were, and a shard is a stretch of that order of SHARD_TOKENS ids or
SHARD_DOCS documents. A term that very many documents share makes many shards, none of them larger.

In a shard the first unused document is the seed; BM25 over all its terms retrieves the unused documents, which fill the window from the
best down. A document that crosses a window's end is cut there, and its rest begins the next window as the seed. Sequences have 1024 tokens;
what is left at a shard's end is cut into sequences whose lengths are powers of two, so there is no padding at all.

Defined results: null and empty texts are one token, the end; long texts are cut, never shortened; repeated rows are packed each by
itself, with equal ids; ties of scores go to the document that comes first in its shard; a null doc_id is packed like any other; an empty table
gives an empty table; other columns don't take part.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hairpin.llm.batches import Texts, arrow_rows, give_back, slices
from hairpin.llm.bpe import Memo, WordCoder, byte_letters
from hairpin.plans.lineage import store

WINDOW = 1024
#: The most of a shard, in ids and in documents; its scores are a matrix of documents by documents.
SHARD_TOKENS, SHARD_DOCS = 1_500_000, 2048
#: Words that a worker remembers; beyond them it starts anew.
MEMO_WORDS = 250_000
#: BM25.
K1, B = 1.2, 0.75
#: The id that ends a document.
END = 0
#: Groups in which document frequencies are summed.
FREQUENCY_PARTS = 16
#: The split pattern of byte-level vocabularies; a fixed value of the file format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: The bytes with which white space beyond ASCII's six begins, which white-space runs may join.
_LEADS = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 white space other than ASCII's six begins."""
    at = np.flatnonzero(_LEADS[data])
    if not len(at):
        return at
    one, two, three = (np.concatenate([data, np.zeros(2, np.uint8)])[at + k].astype(np.int64) for k in range(3))
    pair, triple = one << 8 | two, one << 16 | two << 8 | three
    found = (one < 0x20) | np.isin(pair, [0xC285, 0xC2A0]) | np.isin(triple, [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
    return at[found | ((triple >= 0xE28080) & (triple <= 0xE2808A))]


class ByteCoder(WordCoder):
    """Encodes with a byte-level vocabulary; a part is a run of white space with the word after it, which the split pattern never crosses."""

    def __init__(self, path: str):
        # merges aren't needed here, so the vocabulary's tables aren't built
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.memo_words, self.memo, self._path, self._odd = MEMO_WORDS, Memo(MEMO_WORDS), path, np.zeros(0, np.int64)
        to_byte, special = {c: i for i, c in enumerate(byte_letters())}, {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.terms = max(max(ranks.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self._size = np.zeros(self.terms, np.int64)
        for raw, i in ranks.items():
            self._size[i] = len(raw)
        self._fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def _whole(self) -> Tokenizer:
        """For the few parts with odd white space or special tokens."""
        return Tokenizer.from_file(self._path)

    def spans(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, end, first = texts.words()
        n = len(texts)
        # a last part for the white space that ends a document
        tail = np.flatnonzero(np.where(np.diff(first) > 0, end[np.maximum(first[1:], 1) - 1] if len(end) else 0, texts.offsets[:-1]) < texts.offsets[1:])
        end = np.insert(end, first[1:][tail], texts.offsets[1:][tail])
        first = first + np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=n))])
        start = np.concatenate([[0], end[:-1]]) if len(end) else end
        at = np.diff(first) > 0
        start[first[:-1][at]] = texts.offsets[:-1][at]
        hits, self._odd = odd_spaces(texts.data), np.zeros(0, np.int64)
        if len(hits):
            # a document with such white space is one part
            odd = np.unique(np.searchsorted(texts.offsets, hits, "right") - 1)
            keep = np.ones(len(end), bool)
            for d in odd.tolist():
                keep[first[d] + 1 : first[d + 1]] = False
                end[first[d]] = texts.offsets[d + 1]
            self._odd = texts.offsets[odd]
            first = np.concatenate([[0], np.cumsum(keep)])[first]
            start, end = start[keep], end[keep]
        return start, end, first

    def encode_parts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, count = end - start, np.zeros(len(start), np.int64)
        marked = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        special = np.searchsorted(marked, start) < np.searchsorted(marked, end - 1) if len(marked) else np.zeros(len(start), bool)
        whole = special | np.isin(start, self._odd)
        # parts that begin with white space and end with a word are encoded as one text, and told apart by the bytes of their ids
        joined = ~whole & _SPACES[data[start]] & ~_SPACES[data[end - 1]]
        of = np.flatnonzero(joined)
        before = np.cumsum(size[of]) - size[of]
        text = data[np.repeat(start[of] - before, size[of]) + np.arange(size[of].sum())].tobytes().decode()
        ids = np.array(self._fast.encode_ordinary(text), np.int32)
        ends = np.concatenate([[0], np.searchsorted(np.cumsum(self._size[ids]), before + size[of]) + 1])
        count[of] = np.diff(ends)
        found, rest = [ids], np.flatnonzero(~joined)
        for i in rest.tolist():
            part = data[start[i] : end[i]].tobytes().decode()
            own = self._whole.encode(part, add_special_tokens=False).ids if whole[i] else self._fast.encode_ordinary(part)
            found.append(np.array(own, np.int32))
            count[i] = len(own)
        if len(rest):
            flat, order = np.concatenate(found), np.concatenate([of, rest])
            begin = np.empty(len(start), np.int64)
            begin[order] = np.cumsum(count[order]) - count[order]
            ids = flat[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        return ids, count


_CODERS: dict[str, ByteCoder] = {}


def byte_coder(path: str) -> ByteCoder:
    if path not in _CODERS:
        _CODERS[path] = ByteCoder(path)
    return _CODERS[path]


def postings(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, times) of the distinct terms of each document; terms are token ids, without the end."""
    length = np.diff(first)
    key = np.repeat(np.arange(len(length), dtype=np.uint64), length) << np.uint64(20) | ids.astype(np.uint64)
    key = np.sort(np.delete(key, first[1:] - 1))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[new] >> np.uint64(20)).astype(np.int64), (key[new] & np.uint64((1 << 20) - 1)).astype(np.int64), np.diff(np.append(new, len(key)))


class Statistics:
    """The corpus as BM25 sees it: what a term that occurs so and so often in a document of this length weighs."""

    def __init__(self, frequency: np.ndarray, documents: int, mean_length: float):
        self.idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
        self.mean = max(1.0, mean_length)

    def weight(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.mean))


def scores(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BM25 of each document (column) for all terms of each seed (row), from a shard's postings in order of doc."""
    _, local = np.unique(term, return_inverse=True)
    df = np.bincount(local)
    often = df > max(8, n // 16)
    out = np.zeros((n, n), np.float32)
    # terms that many documents have, a block of columns at a time
    column = np.where(often, np.cumsum(often) - 1, -1)[local]
    for a in range(0, int(often.sum()), 512):
        own = np.flatnonzero((column >= a) & (column < a + 512))
        has, gives = np.zeros((n, 512), np.float32), np.zeros((n, 512), np.float32)
        has[doc[own], column[own] - a], gives[doc[own], column[own] - a] = 1, weight[own]
        out += has @ gives.T
    # the others by their lists
    order = np.flatnonzero(~often[local])
    order = order[np.argsort(local[order], kind="stable")]
    d, w, t = doc[order], weight[order].astype(np.float32), local[order]
    size = df[t]
    begin = np.searchsorted(t, t)
    total = np.concatenate([[0], np.cumsum(size)])
    flat, at = out.ravel(), 0
    while at < len(d):
        to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), "right")) - 1)
        k = size[at:to]
        partner = np.repeat(begin[at:to] - (total[at:to] - total[at]), k) + np.arange(total[to] - total[at])
        np.add.at(flat, np.repeat(d[at:to] * n, k) + d[partner], w[partner])
        at = to
    return out


def pack_shard(ids: np.ndarray, first: np.ndarray, corpus: Statistics, window: int = WINDOW) -> np.ndarray:
    """Rows (doc, start, length, sequence, offset) of the pieces of a shard's documents."""
    length = np.diff(first)
    n = len(length)
    doc, term, times = postings(ids, first)
    score = scores(doc, term, corpus.weight(term, times, length[doc]), n)
    unused, order = np.ones(n, bool), np.empty(n, np.int64)
    fill, seed, first_unused = 0, -1, 0
    for i in range(n):
        best = -1
        if seed >= 0:
            row = np.where(unused, score[seed], 0)
            best = int(row.argmax())
            if row[best] <= 0:
                best = -1
        if best < 0:
            while not unused[first_unused]:
                first_unused += 1
            best = first_unused
        unused[best] = False
        order[i] = best
        fill += int(length[best])
        if fill >= window or seed < 0:
            # the document that is cut at the window's end begins the next one
            fill, seed = fill % window, best
    # windows, then powers of two
    total = int(length.sum())
    bounds = list(range(0, total - total % window + 1, window))
    for bit in reversed(range(window.bit_length())):
        if (total - bounds[-1]) >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    cuts = np.array(bounds)
    ends = np.cumsum(length[order])
    at = np.unique(np.concatenate([cuts[:-1], ends - length[order]]))
    size = np.diff(np.append(at, total))
    row = np.searchsorted(ends, at, "right")
    sequence = np.searchsorted(cuts, at, "right") - 1
    return np.stack([order[row], at - (ends - length[order])[row], size, sequence, at - cuts[sequence]], 1)


def _blobs(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The bytes of values[first[i]:first[i + 1]] for each i."""
    values = np.ascontiguousarray(values)
    offsets = (first * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def _encoded(docs: DataFrame, path: str, text: str) -> DataFrame:
    """Rows (id, n, ids) of each document, and rows (part, counts) of the documents that have each term, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        width = -(-coder.terms // FREQUENCY_PARTS)
        total, kind, some = np.zeros(width * FREQUENCY_PARTS, np.int64), np.uint16 if coder.terms <= 1 << 16 else np.uint32, False
        names = ["id", "n", "ids", "part", "counts"]
        for part, texts in slices(batches, text):
            ids, first = coder.encode(texts)
            ids, first, k, some = np.insert(ids, first[1:], END), first + np.arange(len(first)), len(texts), True
            total += np.bincount(postings(ids, first)[1], minlength=len(total))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(first)), _blobs(ids.astype(kind), first), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if some:
            counts = pa.array([x.tobytes() for x in total.reshape(FREQUENCY_PARTS, width)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(FREQUENCY_PARTS, pa.int64()), pa.nulls(FREQUENCY_PARTS, pa.int64()), pa.nulls(FREQUENCY_PARTS, pa.binary()), pa.array(np.arange(FREQUENCY_PARTS, dtype=np.int32)), counts], names=names)

    return docs.mapInArrow(run, "id long, n long, ids binary, part int, counts binary")


def _statistics(encoded: DataFrame) -> Statistics:
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    rows = encoded.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    frequency = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"]))])
    n, mean = encoded.where("part IS NULL").agg(F.count("*"), F.avg("n")).first()
    return Statistics(frequency, n, mean or 0.0)


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first) of the documents in a batch."""
    length = batch.column("n").to_numpy()
    raw = b"".join(batch.column("ids").to_pylist())
    kind = np.uint16 if len(raw) == 2 * length.sum() else np.uint32
    return np.frombuffer(raw, kind), np.concatenate([[0], np.cumsum(length)])


def _with_heaviest(encoded: DataFrame, shared) -> DataFrame:
    """The documents with the two terms that weigh most in each, -1 for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, first = _ids_of(batch)
            doc, term, times = postings(ids, first)
            weight = shared.value.weight(term, times, np.diff(first)[doc]).astype(np.float32)
            # weights aren't negative, so their bits are in their order; of equal weights the lower term
            key = weight.view(np.uint32).astype(np.int64) << 20 | ((1 << 20) - 1 - term)
            owner, begin = np.unique(doc, return_index=True)
            tops = []
            for _ in range(2):
                top = np.full(batch.num_rows, -1, np.int64)
                if len(owner):
                    best = np.maximum.reduceat(key, begin)
                    top[owner] = np.where(best >= 0, (1 << 20) - 1 - (best & ((1 << 20) - 1)), -1)
                    key[key == np.repeat(best, np.diff(np.append(begin, len(doc))))] = -1
                tops.append(pa.array(top.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *tops], names=[*batch.schema.names, "t1", "t2"])
        give_back()

    return encoded.mapInArrow(run, "id long, n long, ids binary, t1 int, t2 int")


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece, with its ids if asked for."""
    arrow_rows(docs.sparkSession)
    encoded = store(_encoded(docs.select(F.col(doc_id).cast("long").alias("id"), text), path, text))
    shared = docs.sparkSession.sparkContext.broadcast(_statistics(encoded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal sequence
            ids, first = _ids_of(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
            doc, start, length, seq, offset = pack_shard(ids, first, shared.value).T
            raw, begin = ids.astype("<u4"), first[doc] + start
            view = memoryview(raw).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            names = pa.concat_arrays([p.column("id") for p in parts])
            cols = [names.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.diff(first)[doc]), pa.array(sequence + seq), pa.array(offset)]
            if with_ids:
                flat = ids[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat.astype(np.int32))))
            sequence += int(seq.max()) + 1
            return pa.RecordBatch.from_arrays(cols, names=[doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])

        parts, have, rows = [], 0, 0
        for batch in batches:
            at, ends = 0, np.cumsum(batch.column("n").to_numpy())
            while at < batch.num_rows:
                # as many as the shard still takes, and one at least
                before = int(ends[at - 1]) if at else 0
                to = min(int(np.searchsorted(ends, before + shard_tokens - have, "right")), at + SHARD_DOCS - rows)
                to = max(to, at + (not parts))
                if to > at:
                    parts.append(batch.slice(at, to - at))
                    have, rows = have + int(ends[to - 1]) - before, rows + to - at
                if to < batch.num_rows:
                    yield flush(parts)
                    parts, have, rows = [], 0, 0
                at = to
        if parts:
            yield flush(parts)
        give_back()

    terms = _with_heaviest(encoded.where("part IS NULL").select("id", "n", "ids"), shared)
    ordered = terms.repartitionByRange("t1", "t2", "id").sortWithinPartitions("t1", "t2", "id", "n").select("id", "n", "ids")
    return ordered.mapInArrow(run, f"{doc_id} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else ""))
