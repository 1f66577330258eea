"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A string of LENGTH bytes that starts at two places is found in three steps.

1. Shards. The GRAM-byte strings of a text are hashed, and each start is given to the position of the least hash among
   the grams of its LENGTH bytes (its anchor, the leftmost of equals). Equal strings have equal anchors at equal distances, so suffixes can be
   sorted shard by shard, a shard being the anchors of one gram, and nearly all shards hold a single anchor.
   The starts of one anchor are a run; two runs with equal bytes repeat each other as a whole.
2. Blocks. The runs that share a gram with another but differ from it are cut out and laid one below
   the other, anchors in one column. The suffixes that begin in one column are a block. Ranks of the suffixes
   in the columns of a difference cover are computed once, from right to left; then one block at a time
   is sorted by the few bytes before the next cover column and the rank there, which resolves ties of any length. Neighbours
   in that order which agree on LENGTH bytes are repeats. Memory is a block's keys and the cover's ranks.
3. Removal. The covered bytes of each text are united and cut.

The shard of a gram that very many different runs share is parted: the starts of its runs go, with their LENGTH bytes, to shards by a hash
of these bytes, and are sorted there in the same way.

Runs that are equal are folded into one by two independent 64-bit hashes of their bytes; suffixes are compared byte by byte.

Defined results: null and empty texts have no bytes; texts under LENGTH bytes keep all; copies of a text that is long enough lose all
bytes, repeated rows (equal ids too) as well; texts of any length below 256 MB are handled whole, a longer one raises ValueError; an empty
table gives an empty table; other columns stay in :func:`remove`, whatever their names, but for those it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hairpin.llm.batches import OTHER_BASE, Texts, arrow_rows, mix, prefix_hash, quoted, range_hash, slices, span_hashes, with_fields
from hairpin.plans.lineage import discard, store

LENGTH = 200
GRAM = 100
SPAN = LENGTH - GRAM + 1
#: A difference cover modulo 7: each difference of two residues occurs.
PERIOD, COVER = 7, (0, 1, 3)
#: Runs that a task gathers before it sends them on.
GATHERED_RUNS = 200_000
#: Runs of a bucket, expected.
BUCKET_RUNS = 120_000
#: Different runs of one gram beyond which its shard is parted.
PARTED_RUNS = 20_000
FILTER_BITS = 23
_U = np.uint64
_AT = _U(28)


def runs(texts: Texts) -> tuple[np.ndarray, ...]:
    """(doc, start, count, lead, gram, whole, other) of the runs of starts: start within the document, lead the anchor's distance from it,
    whole and other two hashes of the run's bytes and lead."""
    data, offsets = texts.data, texts.offsets
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(_U), none.astype(_U), none.astype(_U)
    if len(data) >> int(_AT):
        raise ValueError("a document of 256 MB or more")
    prefix = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    least = (range_hash(prefix, at, at + GRAM) >> _AT << _AT) | at.astype(_U)
    # the least of SPAN in a row, by doubling
    size = 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
    anchor = (least & _U((1 << 28) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(anchor)]
    begins = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    valid = np.arange(len(anchor)) + LENGTH <= offsets[doc + 1]
    count = np.add.reduceat(valid, begins) if len(begins) else none
    begins, count = begins[count > 0], count[count > 0]
    a, owner = anchor[begins], doc[begins]
    lead = a - begins
    ends = begins + count + LENGTH - 1
    whole = mix(range_hash(prefix, begins, ends) + lead.astype(_U))
    gram = range_hash(prefix, a, a + GRAM)
    other = span_hashes(data, begins, ends, OTHER_BASE)
    return owner, begins - offsets[owner], count, lead, gram, whole, other


def _buckets(names: np.ndarray, owner: np.ndarray, refs: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket: the arrays of its entries, with the refs that they own."""
    order = np.argsort(names, kind="stable")
    found, cuts = np.unique(names[order], return_index=True)
    z, rows = zstandard.ZstdCompressor(level=1), []
    for part in np.split(order, cuts[1:]):
        used, local = np.unique(owner[part], return_inverse=True)
        rows.append([len(part), refs[used].astype(np.int64).tobytes(), z.compress(local.astype(np.uint32).tobytes()), *[z.compress(np.ascontiguousarray(c[part]).tobytes()) for c in columns]])
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "k", "refs", "owner", *[f"c{i}" for i in range(len(columns))]])


def _entries(table: pa.Table, kinds: list[type]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The refs and columns of the entries in rows made by :func:`_buckets`."""
    ref, columns = [], [[] for _ in kinds]
    for refs, owner, *cols in zip(*(table.column(c).to_pylist() for c in ("refs", "owner", *[f"c{i}" for i in range(len(kinds))])), strict=True):
        ref.append(np.frombuffer(refs, np.int64)[np.frombuffer(zstandard.decompress(owner), np.uint32)])
        for out, raw, kind in zip(columns, cols, kinds, strict=True):
            out.append(np.frombuffer(zstandard.decompress(raw), kind))
    return np.concatenate(ref), [np.concatenate(c) for c in columns]


_RUN_KINDS = [np.uint64, np.uint64, np.uint64, np.uint32, np.uint8, np.uint8, np.uint8]
#: What is known of a run: it repeats as a whole; its suffixes are sorted in its gram's shard, or in the parts of that shard.
_REPEATS, _CUT, _PARTED = 1, 2, 4


def _gathered(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """Runs by bucket. Of equal runs in a task one goes to its gram's bucket; the others are known repeats and are dealt out by ref."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        refs: list[np.ndarray] = []
        size = have = 0

        def flush() -> pa.RecordBatch:
            owner, start, count, lead, gram, whole, other = (np.concatenate(c) for c in zip(*waiting, strict=True))
            all_refs = np.concatenate(refs)
            order = np.lexsort((other, whole, gram))
            same = (gram[order][1:] == gram[order][:-1]) & (whole[order][1:] == whole[order][:-1]) & (other[order][1:] == other[order][:-1])
            first = np.concatenate([[True], ~same])
            known = np.zeros(len(order), np.uint8)
            group = np.cumsum(first) - 1
            known[order] = np.where(np.bincount(group)[group] > 1, np.where(first, 1, 2), 0)
            by = np.where(known == 2, (mix(all_refs[owner].view(_U)) % _U(buckets)).astype(np.int64), (mix(gram) % _U(buckets)).astype(np.int64))
            return _buckets(by, owner, all_refs, [gram, whole, other, start.astype(np.uint32), (count - 1).astype(np.uint8), lead.astype(np.uint8), known])

        for part, texts in slices(batches, text):
            owner, *rest = runs(texts)
            refs.append(part.column("ref").to_numpy())
            waiting.append((owner + have, *rest))
            have += part.num_rows
            size += len(owner)
            if size > GATHERED_RUNS:
                yield flush()
                waiting, refs, size, have = [], [], 0, 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "bucket int, k long, refs binary, owner binary, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, c5 binary, c6 binary")


def _judged(gathered: DataFrame) -> DataFrame:
    """Rows (ref, start, count, lead, gram, kind) of the runs that repeat as a whole or share their gram with a different run."""

    def judge(table: pa.Table) -> pa.Table:
        ref, (gram, whole, other, start, count, lead, known) = _entries(table, _RUN_KINDS)
        passed = known == 2
        done = np.flatnonzero(passed)
        live = np.flatnonzero(~passed)
        order = live[np.lexsort((ref[live], other[live], whole[live], gram[live]))]
        g, w, o = gram[order], whole[order], other[order]
        new_gram = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        new_run = new_gram | np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])]) if len(g) else new_gram
        of_run, of_gram = np.cumsum(new_run) - 1, np.cumsum(new_gram) - 1
        often = np.bincount(of_run, 1 + known[order])[of_run] > 1 if len(g) else new_gram
        different = np.bincount(of_gram, new_run)[of_gram] if len(g) else np.zeros(0)
        # one run of each kind is cut out; the others of its kind are whole repeats already
        kind = np.where(often, _REPEATS, 0) | np.where(new_run & (different > 1), np.where(different > PARTED_RUNS, _PARTED, _CUT), 0)
        keep = kind > 0
        take = np.concatenate([order[keep], done])
        kinds = np.concatenate([kind[keep], np.full(len(done), _REPEATS)]).astype(np.int32)
        return pa.table({"ref": ref[take], "start": start[take].astype(np.int64), "count": count[take].astype(np.int32) + 1, "lead": lead[take].astype(np.int32), "gram": gram[take].view(np.int64), "kind": kinds})

    return gathered.groupBy("bucket").applyInArrow(judge, "ref long, start long, count int, lead int, gram long, kind int")


def _filter_bits(refs: DataFrame) -> np.ndarray:
    """A bitmap of 2^FILTER_BITS bits in which every ref of ``refs`` is set."""
    slot = F.col("ref").bitwiseAND((1 << FILTER_BITS) - 1)
    words = refs.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 31 AS INT)))").alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for r in words:
        bits[r["w"]] = r["bits"]
    return bits


def _hit(bits: np.ndarray, refs: np.ndarray) -> np.ndarray:
    slot = refs & ((1 << FILTER_BITS) - 1)
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 > 0


def _only(docs: DataFrame, bits, wanted: bool) -> DataFrame:
    """The rows whose ref is in the bitmap, or those whose isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            yield batch.filter(pa.array(_hit(table, batch.column("ref").to_numpy()) == wanted))

    return docs.mapInArrow(run, docs.schema)


_WIDTH = -(-(SPAN - 1 + LENGTH + 8) // PERIOD) * PERIOD


def sort_blocks(rows: np.ndarray, low: np.ndarray, count: np.ndarray, blocks: int = SPAN) -> Iterator[tuple[int, np.ndarray]]:
    """(column, rows whose LENGTH bytes from there occur in another row) for each block of the laid-out runs; row i's starts are columns
    low[i] to low[i] + count[i] - 1."""
    width = rows.shape[1]
    cover = [c for c in range(width - 8) if c % PERIOD in COVER]
    rank: dict[int, np.ndarray] = {}
    after, after_rank = width - 8, np.zeros(len(rows), np.int64)
    for c in reversed(cover):
        key = after_rank.copy()
        for j in range(c, after):
            key |= rows[:, j].astype(np.int64) << (32 + 8 * (after - 1 - j))
        after, after_rank = c, np.unique(key, return_inverse=True)[1]
        rank[c] = after_rank.astype(np.int32)
    for s in range(blocks):
        block = np.flatnonzero((low <= s) & (s < low + count))
        if len(block) < 2:
            continue
        c = next(c for c in cover if c >= s)
        key = rank[c][block].astype(np.int64)
        for j in range(s, c):
            key |= rows[block, j].astype(np.int64) << (32 + 8 * (c - 1 - j))
        order = block[np.argsort(key, kind="stable")]
        text = rows[order, s : s + LENGTH]
        same = (text[1:] == text[:-1]).all(1)
        yield s, order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]


def _spans_of(ref: np.ndarray, start: np.ndarray) -> pa.Table:
    """Consecutive starts of a ref united: rows (ref, a, b) of the bytes that they cover."""
    order = np.lexsort((start, ref))
    ref, start = ref[order], start[order]
    new = np.concatenate([[True], (ref[1:] != ref[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(ref) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    end = np.concatenate([at[1:], [len(ref)]]) - 1 if len(at) else at
    return pa.table({"ref": ref[at].astype(np.int64), "a": start[at].astype(np.int64), "b": start[end].astype(np.int64) + LENGTH})


_CUT_KINDS = [np.uint64, np.uint32, np.uint8, np.uint8]


def _fine(docs: DataFrame, text: str, judged: DataFrame, bits, buckets: int) -> DataFrame:
    """Spans (ref, a, b) that single starts of the runs which are cut out or spread repeat elsewhere."""
    wanted = judged.where(F.col("kind") > _REPEATS).groupBy("ref").agg(F.collect_list(F.struct("start", "count", "lead", "gram", "kind")).alias("runs"))
    joined = _only(docs.select("ref", text), bits, True).dropDuplicates(["ref"]).join(wanted, "ref")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            refs = part.column("ref").to_numpy()
            lists = part.column("runs")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(refs)), lists.value_lengths().to_numpy())
            start, count, lead, gram, kind = (flat.field(i).to_numpy() for i in range(5))
            base = texts.offsets[owner] + start
            # runs laid out whole
            of = np.flatnonzero(kind & _CUT)
            if len(of):
                size = count[of].astype(np.int64) + LENGTH - 1
                total = np.cumsum(size)
                raw = texts.data[np.repeat(base[of] - (total - size), size) + np.arange(total[-1])]
                by = (mix(gram[of].view(_U)) % _U(buckets)).astype(np.int64)
                order = np.argsort(by, kind="stable")
                names, cuts = np.unique(by[order], return_index=True)
                z, rows = zstandard.ZstdCompressor(level=3), []
                for p in np.split(order, cuts[1:]):
                    body = b"".join(raw[total[i] - size[i] : total[i]].tobytes() for i in p.tolist())
                    rows.append([refs[owner[of[p]]].tobytes(), z.compress(start[of[p]].astype(np.uint32).tobytes()), (count[of[p]] - 1).astype(np.uint8).tobytes(), lead[of[p]].astype(np.uint8).tobytes(), z.compress(body)])
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "refs", "c0", "c1", "c2", "c3"])
            # starts of parted shards, with their bytes; of equal ones in a slice one is sent for two, and the others are known
            of = np.flatnonzero(kind & _PARTED)
            if len(of):
                n = count[of].astype(np.int64)
                total = np.cumsum(n)
                at = np.repeat(base[of] - (total - n), n) + np.arange(total[-1])
                begin = np.repeat(start[of] - (total - n), n) + np.arange(total[-1])
                who = np.repeat(owner[of], n)
                h = range_hash(prefix_hash(texts.data), at, at + LENGTH)
                order = np.argsort(h, kind="stable")
                h, at, begin, who = h[order], at[order], begin[order], who[order]
                strings = np.lib.stride_tricks.sliding_window_view(texts.data, LENGTH)
                same = np.concatenate([[False], h[1:] == h[:-1]])
                for i in range(0, len(at), 4096):  # a few strings at a time
                    k = np.arange(max(1, i), min(len(at), i + 4096))
                    same[k] &= (strings[at[k]] == strings[at[k - 1]]).all(1)
                group = np.cumsum(~same) - 1
                known = np.where(np.bincount(group)[group] > 1, np.where(same, 2, 1), 0).astype(np.uint8)
                by = np.where(known == 2, (mix(refs[who].view(_U)) % _U(buckets)).astype(np.int64), (mix(h) % _U(buckets)).astype(np.int64))
                o2 = np.argsort(by, kind="stable")
                names, cuts = np.unique(by[o2], return_index=True)
                z, rows = zstandard.ZstdCompressor(level=1), []
                for p in np.split(o2, cuts[1:]):
                    live = np.sort(at[p[known[p] < 2]])
                    p = np.concatenate([p[known[p] < 2][np.argsort(at[p[known[p] < 2]])], p[known[p] == 2]])
                    rows.append([z.compress(refs[who[p]].tobytes()), z.compress(begin[p].astype(np.uint32).tobytes()), z.compress(known[p].tobytes()), z.compress(strings[live].tobytes())])
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array((-1 - names).astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols], pa.nulls(len(rows), pa.binary())], names=["bucket", "refs", "c0", "c1", "c2", "c3"])

    packed = joined.select("ref", text, "runs").mapInArrow(cut, "bucket int, refs binary, c0 binary, c1 binary, c2 binary, c3 binary")

    def match(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_pylist() for c in ("refs", "c0", "c1", "c2", "c3")]
        if table.column("bucket")[0].as_py() < 0:
            ref, begin, known, raw = (np.concatenate([np.frombuffer(zstandard.decompress(x), k) for x in c]) for c, k in zip(cols, (np.int64, np.uint32, np.uint8, np.uint8), strict=False))
            live = np.flatnonzero(known < 2)
            # one column of starts, that is, one block
            rows = np.zeros((len(live), LENGTH + PERIOD + 8), np.uint8)
            rows[:, :LENGTH] = raw.reshape(-1, LENGTH)
            found = [x for _, x in sort_blocks(rows, np.zeros(len(live), np.int64), np.ones(len(live), np.int64), 1)]
            good = np.concatenate([np.flatnonzero(known > 0), *(live[x] for x in found)])
            return _spans_of(ref[good], begin[good].astype(np.int64))
        ref = np.concatenate([np.frombuffer(x, np.int64) for x in cols[0]])
        start = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint32) for x in cols[1]]).astype(np.int64)
        count, lead = (np.concatenate([np.frombuffer(x, np.uint8) for x in c]).astype(np.int64) for c in (cols[2], cols[3]))
        count += 1
        raw = np.frombuffer(b"".join(map(zstandard.decompress, cols[4])), np.uint8)
        low = SPAN - 1 - lead
        size = count + LENGTH - 1
        total = np.cumsum(size)
        rows = np.zeros((len(ref), _WIDTH), np.uint8)
        flat = np.repeat(np.arange(len(ref)) * _WIDTH + low - (total - size), size) + np.arange(total[-1])
        rows.ravel()[flat] = raw
        who, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, found in sort_blocks(rows, low, count):
            who.append(found)
            begin.append(start[found] + s - low[found])
        who, begin = np.concatenate(who), np.concatenate(begin)
        return _spans_of(ref[who], begin)

    return packed.groupBy("bucket").applyInArrow(match, "ref long, a long, b long")


def _united(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted(zip(a.tolist(), b.tolist(), strict=True)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def spans(docs: DataFrame, text: str = "text", size_bytes: int | None = None) -> DataFrame:
    """Rows (ref, a, b): repeated bytes of the rows of ``docs``, which has a column ref that tells its rows apart."""
    arrow_rows(docs.sparkSession)
    total = size_bytes if size_bytes is not None else docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(16, int(total * 2 / (SPAN + 1) / BUCKET_RUNS))
    judged = store(_judged(_gathered(docs.select("ref", text), text, buckets)))
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(judged.where(F.col("kind") > _REPEATS)))
    fine = _fine(docs, text, judged, bits, buckets)
    whole = judged.where(F.col("kind").bitwiseAND(_REPEATS) > 0).select("ref", F.col("start").alias("a"), (F.col("start") + F.col("count") + LENGTH - 1).alias("b"))
    found = store(whole.unionByName(fine))
    discard(judged)
    bits.unpersist()
    return found


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (the bytes that stay); these replace columns so named.

    As text, kept is a string without the bytes of characters that a cut has parted.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept")
    columns = [c for c in docs.columns if c not in names]
    # the columns travel as one, so that none of them is in the way
    packed = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in columns]).alias("row"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("ref"))
    found = spans(packed.select("ref", "text"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(found))
    cut_row = with_fields(StructType([packed.schema["row"]]), f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")

    def cut(part: pa.RecordBatch, texts: Texts, lists: list) -> list[pa.Array]:
        rows = []
        for i, own in enumerate(lists):
            raw, gone, at, keep = texts.text(i), 0, 0, []
            merged = _united(np.array([x["a"] for x in own]), np.array([x["b"] for x in own])) if own else []
            for a, b in merged:
                keep.append(raw[at:a])
                gone, at = gone + b - a, b
            keep.append(raw[at:])
            whole = b"".join(keep)
            rows.append((len(raw), gone, len(merged), whole.decode("utf-8", "ignore") if as_text else whole))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Settles the rows that surely lose nothing; the others go on."""
        table = bits.value
        for part, texts in slices(batches):
            hit = pa.array(_hit(table, part.column("ref").to_numpy()))
            none = pa.nulls(part.num_rows, pa.string() if as_text else pa.binary())
            whole = part.column("text") if as_text else part.column("text").cast(pa.binary())
            whole = pc.if_else(hit, none, pc.fill_null(whole, "" if as_text else b""))
            size, zero = pa.array(np.diff(texts.offsets)), pa.array(np.zeros(part.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("row"), size, zero, zero, whole, hit, pc.if_else(hit, part.column("text"), pa.nulls(part.num_rows, pa.string())), part.column("ref")], names=["row", *names, "touched", "text", "ref"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("row"), *cut(part, texts, part.column("spans").to_pylist())], names=["row", *names])

    settled = packed.mapInArrow(first, with_fields(cut_row, "touched boolean, text string, ref long"))
    lists = found.groupBy("ref").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    touched = settled.where("touched").select("row", "text", "ref").join(lists, "ref", "left").select("row", "text", "spans")
    touched = touched.mapInArrow(second, cut_row)
    out = settled.where("NOT touched").select("row", *names).unionByName(touched)
    return out.select(*[F.col("row")[c].alias(c) for c in columns], *names)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    return remove(docs.select(doc_id, text), doc_id, text).select(doc_id, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
