"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles. Tokens are ordered from rare to frequent by a corpus-wide count sketch. Two
sets of a and b tokens with similarity t share at least o = ceil(t / (1 + t) * (a + b)) of them, so for every m the first a - o + m tokens of
the one and the first b - o + m of the other share m or more. Each document chooses its own m: a longer prefix meets more
postings but fewer pairs reach m matches, and the sketch estimates which costs least. A pair is verified only if it
has as many matches as the smaller m of the two asks for.

Documents with equal sets are one class. Links within a group of near copies are found in two steps: every class is
first held against one pivot (of the classes that share a token, that with the fewest rarer ones), then pairs are drawn only between classes that these links
have not joined, by the same rule of matches, so a group of near copies costs its size rather than its square and loses no link that joins components.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; fewer words than a shingle are
one shingle; long texts count whole; copies are linked; rows with equal doc_id are one document with all their links; a null doc_id has
its own row and null component; an empty table gives an empty table; other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hairpin.llm.batches import Texts, arrow_rows, mix, slices, span_hashes
from hairpin.operators.components import connected_components
from hairpin.plans.lineage import cut, discard, in_tasks, store

WORDS = 5
#: The similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Counters of the sketch, whatever the corpus; executors get one byte each.
SKETCH_BITS = 22
SKETCH_PARTS = 16
#: The longest extension of a prefix, and the cost of a verification in postings met.
MOST_MATCHES = 8
VERIFY_COST = 20.0
#: Tokens with a higher estimate aren't gathered by bucket; their postings go on one by one.
HEAVY = 50_000
#: Postings of a bucket, expected.
BUCKET_POSTINGS = 500_000
#: Postings of a task, and pairs whose sets it holds against each other.
POSTINGS_OF_TASK, PAIRS_OF_TASK = 50_000, 2_000
#: Bits of the filter of classes that a verification reads.
FILTER_BITS = 23
_U = np.uint64


def shingles(texts: Texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    low = texts.lowered()
    start, end, first = low.words()
    h = span_hashes(low.data, start, end)
    k = WORDS
    if len(h) >= k:
        whole = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            whole = whole * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        whole = mix(whole)
    else:
        whole = np.zeros(0, _U)
    out, none = [], np.zeros(0, _U)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(whole[a : b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            x = np.array([b - a], _U)
            for w in h[a:b]:
                x = x * _U(0xC2B2AE3D27D4EB4F) + w
            out.append(mix(x))
        else:
            out.append(none)
    return out


def signature(tokens: np.ndarray) -> int:
    """A hash of a set; 0 for the empty one."""
    return int(np.add.reduce(mix(tokens ^ _U(0x5851F42D4C957F2D))).astype(np.int64)) if len(tokens) else 0


def overlap(a: int | np.ndarray, b: int | np.ndarray):
    """The least intersection of sets of a and b tokens that are similar enough."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def _measure(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of two kinds: (id, n, sig) of each document, and the counts of each part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        mask = _U((1 << SKETCH_BITS) - 1)

        def count() -> None:
            slot, n = np.unique(np.concatenate(waiting) & mask, return_counts=True)
            total[slot.astype(np.int64)] += n.astype(np.uint32)

        for part, texts in slices(batches, text):
            sets = shingles(texts)
            waiting += sets
            size += sum(map(len, sets))
            if size > 1 << 20:
                count()
                waiting, size = [], 0
            n = len(sets)
            yield pa.RecordBatch.from_arrays([part.column(doc_id).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["id", "n", "sig", "part", "counts"])
        if size:
            count()
        if total.any():
            z = zstandard.ZstdCompressor(level=1)
            blobs = [z.compress(np.minimum(x, 65535).astype(np.uint16).tobytes()) for x in np.split(total, SKETCH_PARTS)]
            none = pa.nulls(SKETCH_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["id", "n", "sig", "part", "counts"])

    return docs.mapInArrow(run, "id long, n long, sig long, part int, counts binary")


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, in steps of about a tenth."""
    return np.minimum(255, np.round(8 * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)


def _sketch(measured: DataFrame) -> np.ndarray:
    """The corpus-wide counts as levels: 2^SKETCH_BITS bytes."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(zstandard.decompress(blob), np.uint16)
        return pa.table({"part": table.column("part")[:1], "levels": pa.array([_levels(total).tobytes()], pa.binary())})

    rows = measured.where("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(add, "part int, levels binary").coalesce(SKETCH_PARTS).collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        out[r["part"] * (len(out) // SKETCH_PARTS) : (r["part"] + 1) * (len(out) // SKETCH_PARTS)] = np.frombuffer(r["levels"], np.uint8)
    return out


def choose_matches(frequency: np.ndarray, n: int) -> int:
    """The number of matches m of a document of n tokens whose longest prefix has these estimated frequencies, in order."""
    base = n - overlap(n, -(-NUMERATOR * n // DENOMINATOR))
    most = min(MOST_MATCHES, n - base)
    met = np.cumsum(frequency)[base : base + most]
    m = np.arange(1, len(met) + 1)
    return 1 + int(np.argmin(met + VERIFY_COST * met / m)) if len(met) else 1


def _postings(docs: DataFrame, text: str, levels, noise: float, buckets: int) -> DataFrame:
    """Rows (bucket, token, at, n, m, sig blobs) of the prefixes of a slice's classes; heavy tokens are dealt out by class, to negative buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        frequency = np.maximum(0, np.exp2(np.arange(256) / 8) - 1 - noise)
        mask = _U((1 << SKETCH_BITS) - 1)
        for _, texts in slices(batches, text):
            token, owner, at, info, seen = [], [], [], [], set()
            for s in shingles(texts):
                n, sig = len(s), signature(s)
                if not n or sig in seen:
                    continue
                seen.add(sig)
                key = np.sort((table[(s & mask).astype(np.int64)].astype(_U) << _U(56)) | (s >> _U(8)))
                longest = n - overlap(n, -(-NUMERATOR * n // DENOMINATOR)) + MOST_MATCHES
                m = choose_matches(frequency[(key[:longest] >> _U(56)).astype(np.int64)], n)
                take = min(n, longest - MOST_MATCHES + m)
                token.append(key[:take])
                at.append(np.arange(take, dtype=np.uint32))
                owner.append(np.full(take, len(info), np.uint32))
                info.append((sig, n, m))
            if not info:
                continue
            token, owner, at = map(np.concatenate, (token, owner, at))
            heavy = frequency[(token >> _U(56)).astype(np.int64)] > HEAVY
            sig, n, m = (np.array(x) for x in zip(*info, strict=True))
            by_class = (mix(sig.view(_U)) % _U(buckets)).astype(np.int64)[owner]
            bucket = np.where(heavy, -1 - by_class, (mix(token) % _U(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            names, cuts = np.unique(bucket[order], return_index=True)
            rows = []
            for part in np.split(order, cuts[1:]):
                used, local = np.unique(owner[part], return_inverse=True)
                small = np.uint16 if len(used) < 65536 and at[part].max() < 65536 else np.uint32
                rows.append((token[part].tobytes(), np.concatenate([local.astype(small), at[part].astype(small)]).tobytes(), sig[used].astype(np.int64).tobytes(), (n[used].astype(np.int64) << 8 | m[used]).tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "tokens", "owners", "sigs", "sizes"])

    return docs.mapInArrow(run, "bucket int, tokens binary, owners binary, sigs binary, sizes binary")


_POSTING = "token long, sig long, n int, m int, at int"


def _unpack(table) -> tuple[np.ndarray, ...]:
    token, sig, size, at = [], [], [], []
    for t, o, s, z in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "sigs", "sizes")), strict=True):
        k = len(t) // 8
        pair = np.frombuffer(o, np.uint16 if len(o) == 4 * k else np.uint32)
        token.append(np.frombuffer(t, _U))
        sig.append(np.frombuffer(s, np.int64)[pair[:k]])
        size.append(np.frombuffer(z, np.int64)[pair[:k]])
        at.append(pair[k:].astype(np.int32))
    return tuple(map(np.concatenate, (token, sig, size, at)))


def _shared(packed: DataFrame) -> DataFrame:
    """Postings (token, sig, n, m, at), each once: those of the tokens that more than one class has, and all of heavy tokens."""

    def gather(table: pa.Table) -> pa.Table:
        token, sig, size, at = _unpack(table)
        order = np.lexsort((sig, token))
        token, sig, size, at = token[order], sig[order], size[order], at[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        token, sig, size, at = token[keep], sig[keep], size[keep], at[keep]
        if table.column("bucket")[0].as_py() >= 0:
            same = token[1:] == token[:-1]
            many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            token, sig, size, at = token[many], sig[many], size[many], at[many]
        return pa.table([pa.array(token.view(np.int64)), pa.array(sig), pa.array((size >> 8).astype(np.int32)), pa.array((size & 255).astype(np.int32)), pa.array(at)], names=["token", "sig", "n", "m", "at"])

    return packed.groupBy("bucket").applyInArrow(gather, _POSTING)


def _need(x: str, y: str):
    return F.ceil((NUMERATOR * (F.col(f"{x}.n") + F.col(f"{y}.n"))) / (NUMERATOR + DENOMINATOR))


def _may_link(x: str, y: str):
    """Sizes that allow a link, and a shared token within the prefixes in which the pair has one match at least."""
    need = _need(x, y)
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (DENOMINATOR * small >= NUMERATOR * large) & (F.col(f"{x}.at") < F.col(f"{x}.n") - need + 1) & (F.col(f"{y}.at") < F.col(f"{y}.n") - need + 1)


def _verified(docs: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough, judged on their whole sets."""
    spark = docs.sparkSession
    slot = F.col("id").bitwiseAND((1 << FILTER_BITS) - 1)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(slot.alias("s"))
    words = ids.groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s & 31 AS INT)))").alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for r in words:
        bits[r["w"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for _, texts in slices(batches, text):
            found = {}
            for s in shingles(texts):
                sig = signature(s)
                slot = sig & ((1 << FILTER_BITS) - 1)
                if len(s) and (int(wanted[slot >> 5]) >> (slot & 31)) & 1:
                    found[sig] = np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["sig", "tokens"])

    known = docs.mapInArrow(sets, "sig long, tokens binary").groupBy("sig").agg(F.first("tokens").alias("tokens"))
    left = pairs.join(known.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(known.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(raw: bytes) -> np.ndarray:
            wide = np.zeros((len(raw) // 6, 8), np.uint8)
            wide[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            return wide.view(_U).ravel()

        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = numbers(x), numbers(y)
                both = np.sort(np.concatenate([p, q]))
                inter = int((both[1:] == both[:-1]).sum())
                good.append(DENOMINATOR * inter >= NUMERATOR * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return in_tasks(both.select("a", "b", "x", "y"), pairs.count(), PAIRS_OF_TASK).mapInArrow(judge, "a long, b long")


def _with_matches(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes for m = the smaller m of the two share m tokens or more."""
    lists = postings.groupBy("sig").agg(F.collect_list(F.struct("token", "at")).alias("t"))
    both = pairs.join(lists.select(F.col("sig").alias("a"), F.col("t").alias("s")), "a").join(lists.select(F.col("sig").alias("b"), F.col("t").alias("t")), "b")
    m = F.least("x.m", "y.m")
    prefix = lambda c, n: F.transform(F.filter(c, lambda p: p["at"] < n - _need("x", "y") + m), lambda p: p["token"])
    return both.where(F.size(F.array_intersect(prefix("s", F.col("x.n")), prefix("t", F.col("y.n")))) >= m).select("a", "b")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(doc_id, text)
    measured = cut(_measure(docs, doc_id, text))
    rows = measured.where("part IS NULL").select("id", "n", "sig")
    # one vertex for each class; documents that occur in several rows join the classes of all of them
    classes = rows.where("n > 0").groupBy("sig", "n").agg(F.min("id").alias("least"))
    several = rows.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("sig").alias("a"), F.max("sig").alias("b"), F.collect_set("sig").alias("all")).where("a <> b").select("a", F.explode("all").alias("b"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    levels = spark.sparkContext.broadcast(_sketch(measured))
    buckets = max(16, int(total * 0.22 / BUCKET_POSTINGS))
    postings = store(_shared(_postings(docs, text, levels, total / (1 << SKETCH_BITS), buckets)).coalesce(2 * buckets))
    size = postings.count()
    few = lambda df: in_tasks(df, size, POSTINGS_OF_TASK)

    # each class against the pivot that it shares most tokens with
    pivot = postings.groupBy("token").agg(F.min(F.struct("at", "sig", "n", "m")).alias("p"))
    star = postings.alias("x").join(pivot, "token").select("x.*", "p").where((F.col("sig") != F.col("p.sig")) & _may_link("x", "p"))
    sizes = F.first(F.struct("n", "m")).alias("x"), F.first(F.struct("p.n", "p.m")).alias("y")
    star = star.groupBy("sig", F.col("p.sig").alias("b")).agg(F.count("*").alias("c"), *sizes).groupBy("sig").agg(F.max(F.struct("c", "b", "x", "y")).alias("best"))
    star = cut(few(star.select(F.col("sig").alias("a"), "best.b", "best.x", "best.y")))
    linked = cut(_verified(docs, text, cut(few(_with_matches(star, postings)))).unionByName(several))
    joined = connected_components(linked, "a", "b")

    # pairs of classes that aren't joined yet; first has the places of a class's first shared tokens, without m of which in
    # a prefix it can't have m matches
    of_class = Window.partitionBy("sig")
    known = postings.join(joined, F.col("sig") == F.col("id"), "left").select("token", "sig", "n", "m", "at", F.coalesce("component", "sig").alias("c"))
    known = known.withColumn("k", F.row_number().over(of_class.orderBy("at")))
    known = store(few(known.withColumn("first", F.array(*[F.max(F.when(F.col("k") == j, F.col("at"))).over(of_class) for j in range(1, MOST_MATCHES + 1)])).drop("k")))
    mixed = known.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("token")
    left = known.join(mixed, "token", "left_semi")
    x, y = left.alias("x"), left.alias("y")
    m = F.least("x.m", "y.m")
    enough = lambda s: F.coalesce(F.get(f"{s}.first", m - 1) < F.col(f"{s}.n") - _need("x", "y") + m, F.lit(False))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & (F.col("x.sig") < F.col("y.sig")) & _may_link("x", "y") & enough("x") & enough("y"))
    pairs = cut(met.groupBy(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).agg(F.first(F.struct("x.n", "x.m")).alias("x"), F.first(F.struct("y.n", "y.m")).alias("y")))
    more = _verified(docs, text, cut(few(_with_matches(pairs, left))))
    final = connected_components(linked.unionByName(more), "a", "b")
    discard(postings, known)
    levels.unpersist()

    # classes to the least document of their component, and documents to their class
    owned = classes.join(final, F.col("sig") == F.col("id"), "left").select("sig", "n", "least", F.coalesce("component", "sig").alias("c"))
    named = owned.join(owned.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("sig", "n", "component_id")
    out = rows.join(named, ["sig", "n"], "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
