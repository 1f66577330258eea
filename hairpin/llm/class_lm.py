"""Scoring with a Brown class-based bigram model.

Exchange clustering assigns words to classes. The CLUSTERED most frequent words are exchanged one at a time: a word moves to the class in
which the likelihood of the class bigrams is best, until a sweep moves none or SWEEPS are over. All COMMON most frequent words, which make
up most of a text, then join these classes in Spark, a bucket of words at a time: a word's counts with the classes before and after it are
gathered, and it moves to the class under which its places in the corpus are likeliest, in BATCH_SWEEPS sweeps of all words at once. Rarer words belong
to a class of their own kind by their last two bytes, so that every word of the corpus has a class that can be told from the
word. A text's probability is the product over its tokens of P(class | previous class) and P(word | class), both with additive
smoothing; a class keeps one share for words that were never seen. The end of a text is a token and a class of its own.

Counts of words cover the whole training corpus: they are summed by bucket of the word's hash, and each
document's words meet them there. Bounded sizes: executors are sent COMMON words with their classes, and the transitions.

Defined results: a null or empty text has one token, the end; long texts count whole; repeated rows count once each in
training and get equal scores; ties between words of equal count go by hash; an empty table gives an empty table; without training
rows N is 0 and all words are unknown; other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.llm.batches import Texts, arrow_rows, held_out, mix, slices, span_hashes
from hairpin.plans.lineage import store

FOLDS, FOLD = 10, 0
CLUSTERED = 2048
CLASSES = 64
SUFFIX_CLASSES = 64
SWEEPS = 4
BATCH_SWEEPS = 2
#: Words of a bucket whose classes are chosen in one task.
CHOSEN_WORDS = 4096
#: Words whose counts are sent to all tasks, as they make up most tokens; the others are looked up by bucket.
COMMON = 1 << 16
#: Additive smoothing of transitions and emissions.
DELTA, BETA = 0.1, 0.1
#: Distinct words of a bucket, expected.
BUCKET_WORDS = 400_000
#: Tokens that a task gathers before it sends counts on.
GATHERED = 4_000_000
END = CLASSES + SUFFIX_CLASSES
STATES = END + 1
_U = np.uint64
#: The hash that stands for the end.
END_HASH = _U(0)


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix class, first) of the words of each document, in order, without the end."""
    low = texts.lowered()
    start, end, first = low.words()
    h = span_hashes(low.data, start, end)
    h[h == END_HASH] = _U(1)
    last = low.data[end - 1].astype(np.int64)
    before = np.where(end - start > 1, low.data[np.maximum(end - 2, 0)], 0).astype(np.int64)
    suffix = CLASSES + (mix((last << 8 | before).astype(_U)) % _U(SUFFIX_CLASSES)).astype(np.int64)
    return h, suffix, first


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    bucket = (mix(h) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, cuts = np.unique(bucket[order], return_index=True)
    return names, order, np.split(order, cuts[1:]) if len(order) else []


def _word_counts(train: DataFrame, text: str, buckets: int) -> DataFrame:
    """(bucket, h blob, c blob, s blob): the distinct training words of a bucket, their counts and suffix classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            h, s = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(h)
            h, s = h[order], s[order]
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            c = np.diff(np.append(new, len(h)))
            h, s = h[new], s[new]
            names, _, parts = _by_bucket(h, buckets)
            return pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int32)), pa.array([h[p].tobytes() for p in parts], pa.binary()), pa.array([c[p].astype(np.uint32).tobytes() for p in parts], pa.binary()), pa.array([s[p].astype(np.uint8).tobytes() for p in parts], pa.binary())],
                names=["bucket", "h", "c", "s"],
            )

        for part, texts in slices(batches, text):
            h, s, first = tokens(texts)
            ends = part.num_rows
            waiting.append((np.concatenate([h, np.full(ends, END_HASH)]), np.concatenate([s, np.full(ends, END)])))
            size += len(h) + ends
            if size > GATHERED:
                yield flush()
                waiting, size = [], 0
        if size:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        h, c, s = (np.concatenate([np.frombuffer(x, k) for x in table.column(n).to_pylist()]) for n, k in (("h", _U), ("c", np.uint32), ("s", np.uint8)))
        order = np.argsort(h)
        h, c, s = h[order], c[order].astype(np.int64), s[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        c = np.add.reduceat(c, new)
        return pa.table({"bucket": table.column("bucket")[:1], "h": pa.array([h[new].tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary()), "s": pa.array([s[new].tobytes()], pa.binary())})

    schema = "bucket int, h binary, c binary, s binary"
    return train.select(text).mapInArrow(count, schema).groupBy("bucket").applyInArrow(add, schema)


def _common(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the COMMON most frequent words; of equal counts those with the lower hash."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("h").to_pylist(), batch.column("c").to_pylist(), strict=True):
                h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
                best = np.lexsort((h, -c))[:COMMON]
                yield pa.RecordBatch.from_arrays([pa.array(h[best]), pa.array(c[best])], names=["h", "c"])

    rows = counts.select("h", "c").mapInArrow(top, "h long, c long").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    h, c = rows.column("h").to_numpy().view(_U), rows.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


class Lexicon:
    """Ids of the common words by hash: 0 to COMMON - 1, or -1."""

    def __init__(self, h: np.ndarray):
        self.h = h

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


def _states(texts: Texts, lexicon: Lexicon, state_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, common id, state, first) of each document's tokens, each with its end."""
    h, suffix, first = tokens(texts)
    h, suffix = np.insert(h, first[1:], END_HASH), np.insert(suffix, first[1:], END)
    first = first + np.arange(len(first))
    word = lexicon.find(h)
    state = np.where(word >= 0, state_of[word] if len(state_of) else -1, -1)
    return h, word, np.where(state >= 0, state, suffix), first


def _previous(state: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state before each token; a document begins after an end."""
    out = np.concatenate([[END], state[:-1]])
    out[first[:-1]] = END
    return out


def _pair_counts(train: DataFrame, text: str, lexicon, state_of, states: int) -> np.ndarray:
    """Training counts of adjacent states; a bounded matrix, sent by each task as its cells that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = lexicon.value, state_of.value
        total, waiting, size = None, [], 0
        for _, texts in slices(batches, text):
            _, _, state, first = _states(texts, words, table)
            pair = _previous(state, first) * states + state
            waiting.append(pair)
            size += len(pair)
            if size > GATHERED:
                key, c = np.unique(np.concatenate(waiting), return_counts=True)
                total = (key, c) if total is None else _add(total, (key, c))
                waiting, size = [], 0
        if size:
            key, c = np.unique(np.concatenate(waiting), return_counts=True)
            total = (key, c) if total is None else _add(total, (key, c))
        if total is not None:
            part = total[0] // (1 << 16)
            names, cuts = np.unique(part, return_index=True)
            rows = [(a.tobytes(), b.astype(np.int64).tobytes()) for a, b in zip(np.split(total[0], cuts[1:]), np.split(total[1], cuts[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "key", "c"])

    def add(table: pa.Table) -> pa.Table:
        key, c = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(n).to_pylist()]) for n in ("key", "c"))
        uniq, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, c).astype(np.int64)
        return pa.table({"key": pa.array([uniq.tobytes()], pa.binary()), "c": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(states * states)
    for row in train.select(text).mapInArrow(run, "part int, key binary, c binary").groupBy("part").applyInArrow(add, "key binary, c binary").toLocalIterator():
        out[np.frombuffer(row["key"], np.int64)] = np.frombuffer(row["c"], np.int64)
    return out.reshape(states, states)


def _add(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([x[1], y[1]])).astype(np.int64)


def exchange(pairs: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the first ``words`` rows of a matrix of pair counts; later rows are classes of their own that stay.

    Maximises the sum over class pairs of n log n minus that over classes of twice n log n. Words come in by frequency; a word
    moves to the class with the best gain if that is above the one it has.
    """
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    extra = len(pairs) - words
    k = classes + extra
    weight = pairs.sum(0)
    order = np.argsort(-weight[:words], kind="stable")
    owner = np.empty(len(pairs), np.int64)
    owner[order] = np.arange(words) % classes
    owner[words:] = classes + np.arange(extra)
    one = np.zeros((len(pairs), k))
    one[np.arange(len(pairs)), owner] = 1
    to, came = pairs @ one, pairs.T @ one  # counts of each word before and after each class
    between = one.T @ to
    size = between.sum(0)
    out_size = between.sum(1)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            old = owner[w]
            self_count, row, col = pairs[w, w], to[w].copy(), came[w].copy()
            row[old] -= self_count
            col[old] -= self_count
            # without the word
            between[old] -= row
            between[:, old] -= col
            between[old, old] -= self_count
            n_in, n_out = pairs[:, w].sum(), pairs[w].sum()
            size[old] -= n_in
            out_size[old] -= n_out
            # the gain of adding it to each class
            base = between[:classes]
            rows = (xlogx(base + row) - xlogx(base)).sum(1)
            cols = (xlogx(between[:, :classes] + col[:, None]) - xlogx(between[:, :classes])).sum(0)
            d = np.arange(classes)
            diag = between[d, d]
            both = xlogx(diag + row[d] + col[d] + self_count) - xlogx(diag + row[d]) - xlogx(diag + col[d]) + xlogx(diag)
            cost = xlogx(size[d] + n_in) - xlogx(size[d]) + xlogx(out_size[d] + n_out) - xlogx(out_size[d])
            gain = rows + cols + both - cost
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            between[new] += row
            between[:, new] += col
            between[new, new] += self_count
            size[new] += n_in
            out_size[new] += n_out
            if new != old:
                moved += 1
                owner[w] = new
                to[:, old] -= pairs[:, w]
                to[:, new] += pairs[:, w]
                came[:, old] -= pairs[w]
                came[:, new] += pairs[w]
        if not moved:
            break
    return owner[:words]


def best_class(before: np.ndarray, after: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For words with these counts after and before each state, the class of the first CLASSES under which their places are likeliest."""
    smooth = between + DELTA
    into, out = np.log(smooth[:, :CLASSES] / smooth.sum(1, keepdims=True)), np.log(smooth[:CLASSES] / smooth[:CLASSES].sum(1, keepdims=True))
    # a class of many tokens gives each of its words a lesser share
    size = np.log(between[:, :CLASSES].sum(0) + 1)
    return (before @ into + after @ out.T - before.sum(1, keepdims=True) * size).argmax(1)


def _chosen(train: DataFrame, text: str, lexicon, state_of, between) -> dict[int, np.ndarray]:
    """The classes chosen for the common words that training has, by bucket: pairs (number of the word, class)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, states, total, waiting, size = lexicon.value, state_of.value, None, [], 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            found = np.unique(np.concatenate(waiting), return_counts=True)
            return found if total is None else _add(total, found)

        for _, texts in slices(batches, text):
            _, word, state, first = _states(texts, words, states)
            # what comes before is counted under the state, what comes after under the state and a bit
            previous, following = _previous(state, first), np.concatenate([state[1:], [END]])
            own = np.flatnonzero((word >= 0) & (state != END))
            waiting += [word[own] << 9 | previous[own], word[own] << 9 | 256 | following[own]]
            size += 2 * len(own)
            if size > GATHERED:
                total = counted()
                waiting, size = [], 0
        if size:
            total = counted()
        if total is not None:
            names, cuts = np.unique((total[0] >> 9) // CHOSEN_WORDS, return_index=True)
            rows = [(a.tobytes(), b.astype(np.int64).tobytes()) for a, b in zip(np.split(total[0], cuts[1:]), np.split(total[1], cuts[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "key", "c"])

    def choose(table: pa.Table) -> pa.Table:
        first = table.column("bucket")[0].as_py() * CHOSEN_WORDS
        sides = np.zeros((CHOSEN_WORDS, 2, 256))
        for key, c in zip(table.column("key").to_pylist(), table.column("c").to_pylist(), strict=True):
            key = np.frombuffer(key, np.int64) - (first << 9)
            sides.ravel()[key] += np.frombuffer(c, np.int64)
        some = np.flatnonzero(sides.any((1, 2)))
        found = best_class(sides[some, 0, :STATES], sides[some, 1, :STATES], between.value)
        return pa.table({"word": pa.array([(first + some).astype(np.int64).tobytes()], pa.binary()), "state": pa.array([found.astype(np.int64).tobytes()], pa.binary())})

    rows = train.select(text).mapInArrow(gather, "bucket int, key binary, c binary").groupBy("bucket").applyInArrow(choose, "word binary, state binary").collect()
    return {i: np.stack([np.frombuffer(r["word"], np.int64), np.frombuffer(r["state"], np.int64)]) for i, r in enumerate(rows)}


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(doc_id, text, held_out(doc_id, FOLDS, FOLD).alias("held_out"))
    train = docs.where("NOT held_out")
    size = train.select(F.sum(F.octet_length(text))).first()[0] or 0
    # distinct words grow with the text; about one in ten tokens of six bytes is new
    buckets = max(16, int(size / 60 / BUCKET_WORDS))
    counts = store(_word_counts(train, text, buckets))
    common_h, common_c = _common(counts)
    broadcast = spark.sparkContext.broadcast
    # clustering: the most frequent words, the suffix classes of all others, and the end
    is_word = common_h != END_HASH
    ranked = np.lexsort((common_h, -common_c))
    ranked = ranked[is_word[ranked]][:CLUSTERED]
    n_words = len(ranked)
    own = np.full(len(common_h), -1)
    own[ranked] = np.arange(n_words)
    lexicon = broadcast(Lexicon(common_h))

    # in this pass a clustered word is a state of its own, after the class states
    single = np.where(own >= 0, own + STATES, -1)
    pairs = _pair_counts(train, text, lexicon, broadcast(single), STATES + n_words)
    arrange = np.concatenate([STATES + np.arange(n_words), CLASSES + np.arange(SUFFIX_CLASSES + 1)])
    pairs = pairs[np.ix_(arrange, arrange)]
    owner = exchange(pairs, n_words, CLASSES)
    state_of = np.full(len(common_h), -1)
    state_of[ranked] = owner
    # transitions of classes follow from those of words
    group = np.concatenate([owner, np.arange(CLASSES, STATES)]).astype(np.int64)
    between = np.zeros((STATES, STATES))
    np.add.at(between, (group[:, None], group[None, :]), pairs)
    # all common words, but for those exchanged one by one and the end
    seeds = np.zeros(len(common_h), bool)
    seeds[ranked] = True
    for _ in range(BATCH_SWEEPS if is_word.sum() > n_words else 0):
        before = state_of.copy()
        for word, state in _chosen(train, text, lexicon, broadcast(state_of), broadcast(between)).values():
            free = ~seeds[word]
            state_of[word[free]] = state[free]
        if (before == state_of).all():
            break
        between = _pair_counts(train, text, lexicon, broadcast(state_of), STATES)
    shift = np.log10((between + DELTA) / (between.sum(1, keepdims=True) + DELTA * STATES))

    placed = np.flatnonzero(state_of >= 0)
    clustered = broadcast((common_h[placed], state_of[placed]))
    totals, kinds = _class_sizes(counts, clustered)
    n, v = int(totals.sum()), int(kinds.sum())
    # an end is certain once its class is
    emission = lambda c, state: np.where(state == END, 0.0, np.log10((c + BETA) / (totals[state] + BETA * (kinds[state] + 1))))
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    model = broadcast((common_c, state_of, shift))

    schema = "bucket int, serial long, ids array<long>, held array<boolean>, h binary, doc binary, state binary, sums binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per slice one row with the sums over transitions and common words, and one for each bucket of its rare words."""
        common_count, states, moves = model.value
        words, serial, z = lexicon.value, TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        names = ["bucket", "serial", "ids", "held", "h", "doc", "state", "sums"]
        longs, flags = pa.list_(pa.int64()), pa.list_(pa.bool_())
        for part, texts in slices(batches, text):
            serial += 1
            h, word, state, first = _states(texts, words, states)
            k = len(texts)
            doc = np.repeat(np.arange(k), np.diff(first))
            common = word >= 0
            c = common_count[word[common]]
            sums = np.concatenate([
                np.bincount(doc[common], base(c), k),
                np.bincount(doc, moves[_previous(state, first), state], k) + np.bincount(doc[common], emission(c, state[common]), k),
                np.bincount(doc[common], minlength=k),
                np.diff(first),
            ])
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int32()), pa.array([serial]), pa.array([part.column(doc_id).cast(pa.int64()).to_pylist()], longs), pa.array([part.column("held_out").to_pylist()], flags), *[pa.nulls(1, pa.binary())] * 3, pa.array([sums.tobytes()], pa.binary())],
                names=names,
            )
            rare = np.flatnonzero(~common)
            if not len(rare):
                continue
            found, _, parts = _by_bucket(h[rare], buckets)
            rows = [(h[p].tobytes(), z.compress(doc[p].astype(np.uint32).tobytes()), z.compress(state[p].astype(np.uint8).tobytes())) for p in (rare[x] for x in parts)]
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array(np.full(m, serial)), pa.nulls(m, longs), pa.nulls(m, flags), *[pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], pa.nulls(m, pa.binary())],
                names=names,
            )

    sent = store(docs.mapInArrow(local, schema))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each slice the sums over its documents of what this bucket's words give."""
        h, c = (np.frombuffer(right.column(x)[0].as_py(), t) if right.num_rows else np.zeros(0, t) for x, t in (("h", _U), ("c", np.int64)))
        rows = []
        for serial, want, doc, state in zip(*(left.column(x).to_pylist() for x in ("serial", "h", "doc", "state")), strict=True):
            want, doc, state = np.frombuffer(want, _U), np.frombuffer(zstandard.decompress(doc), np.uint32), np.frombuffer(zstandard.decompress(state), np.uint8).astype(np.int64)
            count = np.zeros(len(want), np.int64)
            if len(h):
                at = np.minimum(np.searchsorted(h, want), len(h) - 1)
                count = np.where(h[at] == want, c[at], 0)
            k = int(doc.max()) + 1
            rows.append((serial, np.concatenate([np.bincount(doc, base(count), k), np.bincount(doc, emission(count, state), k), np.bincount(doc[count > 0], minlength=k), np.zeros(k)]).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[], []]
        return pa.table({"serial": pa.array(cols[0], pa.int64()), "sums": pa.array(cols[1], pa.binary())})

    rare = sent.where("bucket >= 0").select("bucket", "serial", "h", "doc", "state").groupBy("bucket").cogroup(counts.select("bucket", "h", "c").groupBy("bucket")).applyInArrow(look_up, "serial long, sums binary")
    everything = sent.where("bucket < 0").select("serial", "ids", "held", "sums").unionByName(rare, allowMissingColumns=True)

    def add_up(table: pa.Table) -> pa.Table:
        ids = held = None
        parts = []
        for i, f, raw in zip(*(table.column(x).to_pylist() for x in ("ids", "held", "sums")), strict=True):
            if i is not None:
                ids, held = i, f
            parts.append(np.frombuffer(raw, np.float64).reshape(4, -1))
        total = np.zeros((4, len(ids)))
        # in one order, so that a sum doesn't depend on when its parts came
        for x in sorted(parts, key=lambda x: (x.shape, x.tobytes())):
            total[:, : x.shape[1]] += x
        counts4 = np.round(total[2:]).astype(np.int64)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": counts4[1], "n_known": counts4[0], "train_tokens": np.full(len(ids), n, np.int64), "base_score": total[0], "score": total[1]})

    out = everything.groupBy("serial").applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", doc_id)


def _class_sizes(counts: DataFrame, clustered) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, distinct words) of each state in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, owner = clustered.value
        order = np.argsort(words)
        lexicon, owner = Lexicon(words[order]), owner[order]
        for batch in batches:
            for h, c, s in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "s")), strict=True):
                h, c, s = np.frombuffer(h, _U), np.frombuffer(c, np.int64), np.frombuffer(s, np.uint8).astype(np.int64)
                at = lexicon.find(h)
                s = np.where(at >= 0, owner[at] if len(owner) else s, s)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(STATES)), pa.array(np.bincount(s, c, STATES).astype(np.int64)), pa.array(np.bincount(s, minlength=STATES))], names=["state", "total", "kinds"])

    totals, kinds = np.zeros(STATES), np.zeros(STATES)
    for r in counts.mapInArrow(run, "state long, total long, kinds long").groupBy("state").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).collect():
        totals[r["state"]], kinds[r["state"]] = r["total"], r["kinds"]
    return totals, kinds
