"""Operators of the corpus against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from hairpin.llm import bm25_packing, bpe, class_lm, embedding_dedup, jaccard_join, language_id, quality_classifier, quality_rules, range_coder, suffix_dedup  # noqa: E402
from hairpin.llm.batches import texts_of  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SPACE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(60)
    base = say(120).split()
    texts = [None, "", "   \n\t ", "one", "One", "a b c d", "one two three four five", say(20), say(3000), say(50) + "\n" + passage, passage + "\n" + say(30), "x" * 900, "yx" * 450, passage, passage]
    for k in range(30):
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [say(rng.randint(5, 90)) for _ in range(40)]
    texts += ["<|endoftext|> ΑΣΣ don't 12345 \x1c   é é 🙂 " + say(4), "A\r\nB\x0bC\x0cD", "line one is here\nline one is here\nline two is here now ok yes\n" * 3]
    return list(enumerate(texts, 1))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # columns whose names the operators use themselves
    rows = [(d, t, ("en", "de")[d % 2], 7, "mine", 3.0) for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, ref string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_quality_rules(docs, empty, corpus):
    got = {r.doc_id: r for r in quality_rules.annotate(docs).collect()}
    for d, t in corpus:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen, covered = Counter(windows), set()
        for i, k in enumerate(windows):
            if seen[k] > 1:
                covered.update(range(i, i + 5))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)), (d, t)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and (not r.base_failed or not r.kept)
    assert quality_rules.annotate(empty).count() == 0
    assert "Python" not in quality_rules.annotate(docs)._jdf.queryExecution().toString()


def test_bpe_equals_the_library(spark, docs, empty, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.digests(docs, WORD).collect()}
    for d, t in corpus:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == want, t
    assert bpe.digests(empty, WORD).count() == 0


def test_merges_take_the_leftmost_lowest_rank():
    v = bpe.Vocabulary(WORD)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abcehinotr") for _ in range(rng.randint(1, 70))).encode() for _ in range(300)] + [b"a" * 1000]
    flat, begin, count = bpe.merge(v, pieces)
    for piece, a, n in zip(pieces, begin.tolist(), count.tolist(), strict=True):
        ids = flat[a : a + n]
        s = [*v.base[np.frombuffer(piece, np.uint8)].tolist()]
        s[-1] = int(v.last[piece[-1]])
        while len(s) > 1:
            ranks = v.rank(np.array(s[:-1]), np.array(s[1:]))
            if ranks.max() < 0:
                break
            i = int(np.argmin(np.where(ranks < 0, 1 << 40, ranks)))
            s[i : i + 2] = [int(v.merged[ranks[i]])]
        assert ids.tolist() == s


def components(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("heavy", [50_000, 0])
def test_jaccard_join(docs, empty, corpus, monkeypatch, heavy):
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    sets = {}
    for d, t in corpus:
        w = words(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, sets)
    rows = jaccard_join.components(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {d: (len(sets[d]), want[d]) for d in sets} and len(rows) == len(corpus)
    assert len(set(want.values())) < len(want) - 15
    if heavy:
        assert jaccard_join.components(empty).count() == 0


def test_matches_follow_the_cost():
    rare, common = np.zeros(60), np.concatenate([np.zeros(10), np.full(50, 1000.0)])
    assert jaccard_join.choose_matches(rare, 100) == 1
    steep = np.concatenate([np.full(21, 10.0), np.full(39, 1.0)])
    assert jaccard_join.choose_matches(steep, 100) > 1
    assert 1 <= jaccard_join.choose_matches(common, 100) <= jaccard_join.MOST_MATCHES


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, empty, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "PARTED_RUNS", hot)
    size = suffix_dedup.LENGTH
    raw = {d: (t or "").encode() for d, t in corpus}
    count = Counter(b[i : i + size] for b in raw.values() for i in range(len(b) - size + 1))
    got = {r.doc_id: r for r in suffix_dedup.digests(docs).collect()}
    for d, b in raw.items():
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                cut[i : i + size] = True
        spans = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest()
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), int(cut.sum()), spans, kept), d
    assert len(got) == len(corpus)
    if hot > 1:
        assert suffix_dedup.digests(empty).count() == 0
        whole = suffix_dedup.remove(docs, as_text=True)
        assert whole.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"]
        assert {(r.doc_id, r.n, r.ref) for r in whole.collect()} == {(d, 7, "mine") for d, _ in corpus}


def test_the_cover_meets_every_difference():
    p = suffix_dedup.PERIOD
    assert {(a - b) % p for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(p))


def test_class_lm(docs, empty, corpus, monkeypatch):
    # of about 400 words 100 are exchanged one by one and 200 more join their classes; scores are those of a plain model with the same classes
    monkeypatch.setattr(class_lm, "CLUSTERED", 100)
    monkeypatch.setattr(class_lm, "COMMON", 300)
    kept = {}
    monkeypatch.setattr(class_lm, "_class_sizes", lambda counts, clustered, real=class_lm._class_sizes: kept.update(zip(*[x.tolist() for x in clustered.value], strict=True)) or real(counts, clustered))
    token = lambda t: [*words(lower(t)), None]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in corpus}
    c = Counter(w for d, t in corpus if not held[d] for w in token(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in class_lm.score(docs).collect()}
    text = words(" ".join({w for _, t in corpus for w in words(lower(t))}))
    h, suffix, _ = class_lm.tokens(texts_of(pa.array([" ".join(text)])))
    state = {w: kept.get(int(x), int(s)) for w, x, s in zip(text, h.tolist(), suffix.tolist(), strict=True)} | {None: class_lm.END}
    assert 200 < sum(s < class_lm.CLASSES for s in state.values()) <= 300
    moves, totals, kinds = Counter(), Counter(), Counter()
    for d, t in corpus:
        if not held[d]:
            states = [class_lm.END, *(state[w] for w in token(t))]
            moves.update(zip(states[:-1], states[1:], strict=True))
    for w, k in c.items():
        totals[state[w]] += k
        kinds[state[w]] += 1
    out = Counter()
    for (a, _), k in moves.items():
        out[a] += k

    def plain(t):
        total, at = 0.0, class_lm.END
        for w in token(t):
            s = state[w]
            total += math.log10((moves[at, s] + 0.1) / (out[at] + 0.1 * class_lm.STATES))
            total += 0 if w is None else math.log10((c[w] + 0.1) / (totals[s] + 0.1 * (kinds[s] + 1)))
            at = s
        return total

    for d, t in corpus:
        w, r = token(t), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score == pytest.approx(plain(t))
    assert got[2].score == got[1].score and class_lm.score(empty).count() == 0


def test_words_join_the_class_of_their_places():
    between = np.full((class_lm.STATES, class_lm.STATES), 1.0)
    between[3, 5] = between[5, 7] = 1000
    before, after = np.zeros((2, class_lm.STATES)), np.zeros((2, class_lm.STATES))
    before[0, 3], after[0, 7] = 4, 4
    assert class_lm.best_class(before, after, between)[0] == 5


def test_class_model_sums_to_one():
    """Over the next states the transitions, and over a class's words with the unknown one the emissions."""
    between = np.array([[3.0, 0], [1, 5]])
    shift = (between + class_lm.DELTA) / (between.sum(1, keepdims=True) + class_lm.DELTA * 2)
    assert shift.sum(1) == pytest.approx(1)
    counts = np.array([4, 2, 1])
    assert ((counts + class_lm.BETA) / (7 + class_lm.BETA * 4)).sum() + class_lm.BETA / (7 + class_lm.BETA * 4) == pytest.approx(1)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(0)
    n, k = 40, 4
    owner = np.arange(n) % k
    pairs = np.zeros((n + 1, n + 1))
    for _ in range(40_000):
        a = rng.integers(n)
        b = rng.choice(np.flatnonzero(owner == (owner[a] + 1) % k))
        pairs[a, b] += 1
    shuffled = rng.permutation(n)
    order = np.append(shuffled, n)
    found = class_lm.exchange(pairs[np.ix_(order, order)], n, k, 10)
    for c in range(k):
        assert len(set(owner[shuffled][found == c])) == 1


def test_packing(docs, empty, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTE)
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for d, t in corpus}
    rows = bm25_packing.pack(docs, BYTE, with_ids=True).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == own and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r.doc_id][r.start] = r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, own in pieces.items():
        at = 0
        for start, n in sorted(own.items()):
            assert start == at
            at += n
        assert at == len(ids[d])
    assert set(pieces) == set(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert bm25_packing.pack(empty, BYTE).count() == 0


def plain_order(docs, window):
    """Greedy packing by BM25 over dictionaries: the order of the documents."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    terms = [Counter(d[:-1]) for d in docs]
    df = Counter(t for c in terms for t in c)
    idf = {t: math.log(1 + (n - k + 0.5) / (k + 0.5)) for t, k in df.items()}

    def score(seed, d):
        k1, b = bm25_packing.K1, bm25_packing.B
        return sum(idf[t] * terms[d][t] * (k1 + 1) / (terms[d][t] + k1 * (1 - b + b * len(docs[d]) / mean)) for t in terms[seed] if t in terms[d])

    left, order, fill, seed = list(range(n)), [], 0, None
    while left:
        best = max(left, key=lambda d: (score(seed, d), -d)) if seed is not None else left[0]
        if seed is not None and score(seed, best) <= 0:
            best = left[0]
        left.remove(best)
        order.append(best)
        fill += len(docs[best])
        if fill >= window or seed is None:
            fill, seed = fill % window, best
    return order


@pytest.mark.parametrize("n", [1, 7, 150])
def test_windows_are_filled_as_plain_bm25_fills_them(n):
    rng = np.random.default_rng(n)
    docs = [[*(rng.zipf(1.3, rng.integers(0, 60)) % 3000 + 20 * rng.integers(1, 40)).tolist(), 0] for _ in range(n)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    ids = np.concatenate([np.array(d) for d in docs])
    term = bm25_packing.postings(ids, first)[1]
    corpus = bm25_packing.Statistics(np.bincount(term, minlength=5000), n, np.diff(first).mean())
    pieces = bm25_packing.pack_shard(ids, first, corpus, window=64)
    assert list(dict.fromkeys(pieces[:, 0].tolist())) == plain_order(docs, 64)


def test_equal_scores_go_to_the_first_and_copies_stand_together_across_partitions(spark):
    first = np.arange(0, 13, 3)
    ids = np.array([5, 6, 0, 5, 7, 0, 5, 7, 0, 8, 9, 0])
    corpus = bm25_packing.Statistics(np.array([0] * 5 + [3, 1, 2, 1, 1]), 4, 3.0)
    assert list(dict.fromkeys(bm25_packing.pack_shard(ids, first, corpus, window=4)[:, 0].tolist())) == [0, 1, 2, 3]
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(60)]
    df = spark.createDataFrame([(i, texts[i % 60], 1, 2) for i in range(240)] + [(None, "a b", 1, 2)], "doc_id long, text string, t1 int, part int").repartition(6)
    rows = bm25_packing.pack(df, BYTE, shard_tokens=2000).collect()
    where = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            where[r.doc_id % 60].add(r.sequence_id >> 36)
    assert len(rows) >= 241 and np.mean([len(x) for x in where.values()]) < 2 and any(r.doc_id is None for r in rows)


def test_parts_of_texts_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(BYTE), bm25_packing.byte_coder(str(BYTE))
    rng = random.Random(11)
    letters = ["a", "B", "'s", "'", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "é", "ß", "漢", "🙂", "12", "<|", "|>", "<|endoftext|>", "--", "word", "words"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    ids, first = fast.encode(texts_of(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    memo = bpe.Memo(100)
    memo.add(np.arange(1, 51, dtype=np.uint64) << np.uint64(40), np.arange(100, dtype=np.int32), np.full(50, 2))
    assert memo.find(np.array([1 << 40, 50 << 40, 51 << 40], np.uint64)).tolist() == [0, 49, -1] and memo.flat[memo.begin[49]] == 98


def test_range_coder_round_trip(spark, docs, empty, corpus):
    from tokenizers import Tokenizer

    whole, start = Tokenizer.from_file(WORD), 0
    got = {r.doc_id: r for r in range_coder.round_trip(docs, WORD).collect()}
    for d, t in sorted(corpus):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), d
        start += len(ids)
    assert range_coder.round_trip(empty, WORD).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "skewed", "constant", "edge", "wide"])
def test_blocks_decode_to_what_was_encoded(kind):
    rng = np.random.default_rng(4)
    ids = {"uniform": rng.integers(0, 49408, 5000), "skewed": rng.zipf(1.2, 5000) % 49408, "constant": np.full(5000, 49407), "edge": rng.choice([0, 255, 256, 49407], 5000), "wide": rng.choice([0, 65535, 65536, 99999], 5000)}[kind].astype(np.int32)
    size = 100_000 if kind == "wide" else 49408
    lengths = np.array([1024, 1024, 1024, 1024, 904])
    coded, counts = range_coder.encode_blocks(ids, lengths, size)
    assert (range_coder.decode_blocks(coded, counts, lengths, size) == ids).all()
    if kind in ("constant", "skewed"):
        assert 4 * len(coded) < (600 if kind == "constant" else 1.8 * len(ids))
    # a block is read without the others
    at = np.cumsum(counts) - counts
    one = range_coder.decode_blocks(coded[at[2] : at[2] + counts[2]], counts[2:3], lengths[2:3], size)
    assert (one == ids[2048:3072]).all()


def test_the_mixture_is_a_distribution():
    """The intervals of all ids lie one after the other below the total, and each id is found from both its ends."""
    rng = np.random.default_rng(5)
    n, size = 3, 900
    model = range_coder.Model(n, size)
    for t in range(70):
        model.predict(t, n)
        now = (rng.zipf(1.3, n) % size) if t % 3 else np.array([7, 7, 9])
        model.interval(n, now)
        model.learn(n, now)
    model.predict(70, n)
    end = np.zeros(n, np.int64)
    for i in range(size):
        ids = np.full(n, i)
        start, width = model.interval(n, ids)
        assert (start == end).all() and (width > 0).all()
        assert (model.find(n, start) == i).all() and (model.find(n, start + width - 1) == i).all()
        end = start + width
    assert (end <= 1 << 31).all() and (end > 0.97 * (1 << 31)).all()


def test_damage_is_found(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    path, bad = f"{tmp_path}/ids", f"{tmp_path}/bad"
    range_coder.write(docs, WORD, path)
    t = spark.read.parquet(path)
    t.withColumn("block_crc32", F.unhex(F.regexp_replace(F.hex("block_crc32"), "^..", "00"))).write.parquet(bad)
    with pytest.raises(Exception, match="damaged"):
        range_coder.read(spark, bad).collect()


def _speech(seed, letters, n, labels=False):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(8, 60))) for _ in range(n)]


def test_language_id(spark, empty):
    made = [(t, "xx") for t in _speech(1, ["ba", "du", "ke", "lo"], 120)] + [(t, "yy") for t in _speech(2, ["sti", "ner", "vau", "pfo"], 120)] + [(None, "xx"), ("", "yy"), ("12 !? 9", "xx"), ("ba du", None)]
    df = spark.createDataFrame([(i, t, lang, "clash") for i, (t, lang) in enumerate(made)], "doc_id long, text string, lang string, margin string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    right = [got[i].lang_pred == lang for i, (t, lang) in enumerate(made) if t and lang and any(c.isalpha() for c in t)]
    assert np.mean(right) > 0.98
    assert all(got[i].lang_pred == "und" and not got[i].accepted and got[i].score == 0 for i in (240, 241, 242)) and got[243].lang_pred in ("xx", "yy")
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(made)
    assert language_id.identify(empty).count() == 0


def test_the_smallest_encoding_wins(spark):
    """Every text against every dictionary in a plain loop, with the margin to the second smallest."""
    import zstandard

    made = [(t, lang) for k, (lang, letters) in enumerate([("xx", ["ba", "du", "ke"]), ("yy", ["ba", "ner", "vau"]), ("zz", ["du", "ner", "é"])]) for t in _speech(20 + k, letters, 40)]
    made += [(made[0][0] + "\n" + made[50][0], None), (" -- ".join(t for t, _ in made[80:110]), None), ("ba", None), ("é", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "doc_id long, text string, lang string")
    learned = language_id.train(df)
    params = zstandard.ZstdCompressionParameters(**language_id.COMPRESSION)
    narrow = 0
    for r in language_id.predict(df, learned).collect():
        raw = re.sub(r"[\W\d_]+", " ", r.text).strip().lower().encode()
        sizes = []
        for lang, content in learned.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            sizes.append((sum(len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(raw[i : i + language_id.BLOCK_BYTES])) for i in range(0, len(raw), language_id.BLOCK_BYTES)), lang))
        (best, lang), (second, _) = sorted(sizes, key=lambda x: x[0])[:2]
        assert (r.lang_pred, r.accepted) == (lang, (second - best) / best >= language_id.MIN_MARGIN) and r.margin == pytest.approx((second - best) / best)
        narrow += not r.accepted
    assert narrow and max(len(t) for t, _ in made) > 2 * language_id.BLOCK_BYTES


def test_copies_and_shared_heads_leave_no_language_unlearned(spark):
    head = "same head of all pages " * 60
    rows = [("aa", "abc abd acd " * 20 + "bcd"), ("aa", "dab cab bad " * 20)] * 3000 + [("bb", head + f"xyz zyx {'xz' * k} yxz zzy " * 50) for k in range(1, 9)] + [("cc", "né"), ("cc", "12 34")]
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    learned = language_id.train(df)
    assert list(learned) == ["aa", "bb", "cc"]
    assert b"abc abd" in learned["aa"] and b"dab cab" in learned["aa"] and b"zyx" in learned["bb"]
    assert language_id.Encoder(learned).predict("xyz zyx yxz zzy xyz zyx yxz")[0] == "bb"


@pytest.mark.parametrize("n", [200, 900])
def test_the_sample_is_the_texts_with_the_lowest_hashes(spark, monkeypatch, n):
    monkeypatch.setattr(language_id, "DICTIONARY_BYTES", 1 << 20)
    df = spark.createDataFrame([(i, "aa", "q" * (i % n + 1)) for i in range(3 * n)], "doc_id long, lang string, text string")
    kept = language_id.train(df)["aa"].decode().split()
    assert len(set(kept)) == len(kept) == 200


def test_every_passage_of_the_sample_is_in_the_dictionary(spark):
    """With the production constants: 200 texts of 3,000 characters, each with a letter of its own."""
    own = [chr(0x4E00 + i) for i in range(200)]
    df = spark.createDataFrame([(i, "zh", f"{c}{c} " * 1000) for i, c in enumerate(own)], "doc_id long, lang string, text string")
    learned = language_id.train(df)["zh"]
    assert len(learned) <= language_id.DICTIONARY_BYTES and all(learned.decode().count(c) >= 40 for c in own)
    made = language_id.dictionary(["ab", "é" * 40_000, "x y " * 20_000])
    assert 0 <= language_id.DICTIONARY_BYTES - len(made) < 4 and made.startswith(b"ab x y x") and made.decode().count("é") > 8_000


def test_copies_leave_the_quality_sample_whole(spark):
    """Few texts in very many copies are learned from whole; long texts count by their bytes."""
    from pyspark.sql import functions as F

    q = quality_classifier
    many = spark.range(200_000).select(F.concat_ws(" ", F.lit("word"), F.concat(F.lit("w"), F.col("id") % 30)).alias("text"), (F.col("id") % 2).cast("int").alias("label"))
    w = q.train(many)
    assert np.count_nonzero(w) > 40
    got = {r.text: r for r in q.score(many.distinct(), w).collect()}
    assert len(got) == 30 and all((r.score > 0.5) == bool(r.label) for r in got.values())
    assert (q.train(many.distinct()) == w).all()
    docs = many.distinct().withColumn("doc_id", F.xxhash64("text"))
    assert (q.train_by_id(docs.drop("label"), docs.select("doc_id", "label")) == w).all()


def test_the_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    q = quality_classifier
    monkeypatch.setattr(q, "SAMPLE_BYTES", 100_000)
    rows = spark.range(400).select(F.concat_ws(" ", F.concat(F.lit("t"), "id"), F.expr("repeat('x ', 1000)")).alias("text"), (F.col("id") % 2).alias("label"))
    # each text has a word and a pair of its own
    assert 2 * 20 < np.count_nonzero(q.train(rows)) < 2 * 100


def test_quality_classifier(spark, empty):
    good, bad = _speech(3, ["an", "de", "ro"], 150), [t.replace(" ", " $$ zap ") for t in _speech(4, ["an", "de", "ro"], 150)]
    rows = [(i, t, "clash") for i, t in enumerate([*good, *bad, None, "", "  "])]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(5, 1), (300, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(df, labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert held and np.mean([(got[i].score > 0.5) == (i < 150) for i in held]) > 0.97
    assert got[300].score == got[301].score == got[302].score and all(r.predicted == int(r.score >= 0.7) for r in got.values()) and len(got) == 303
    assert quality_classifier.classify(empty, labels).count() == 0
    none = quality_classifier.classify(df, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_scores_are_those_of_a_plain_learner(spark):
    """Follow-the-regularised-leader updates one feature at a time, over dictionaries keyed by the words themselves."""
    from pyspark.sql import functions as F

    q, rng = quality_classifier, random.Random(8)
    texts = [" ".join(rng.choice(["An", "de", "ro", "$$", "zap", "mi"]) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    df = spark.createDataFrame([(t, int("zap" not in t)) for t in texts], "text string, label int")
    z, n = defaultdict(float), defaultdict(float)

    def vector(text):
        own = words(lower(text))
        count = Counter(own) + Counter(zip(own, own[1:], strict=False))
        return {None: 1.0} | {k: math.sqrt(c / count.total()) for k, c in count.items()}

    def weight(k):
        return 0.0 if abs(z[k]) <= q.L1 else (math.copysign(q.L1, z[k]) - z[k]) / ((q.BETA + math.sqrt(n[k])) / q.ALPHA + q.L2)

    def probability(x):
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))

    order = df.distinct().orderBy(F.xxhash64("text", F.lit(11)), "label").collect()
    for r in order * 8:
        x = vector(r.text)
        error, before = probability(x) - r.label, {k: weight(k) for k in x}
        for k, v in x.items():
            after = n[k] + (error * v) ** 2
            z[k] += error * v - (math.sqrt(after) - math.sqrt(n[k])) / q.ALPHA * before[k]
            n[k] = after
    got = {r.text: r.score for r in q.score(df, q.train(df)).collect()}
    assert all(got[t] == pytest.approx(probability(vector(t)), abs=1e-3) for t in texts) and len(set(got.values())) > 20


def test_features_are_lengths_of_one():
    first, feature, value = quality_classifier.features(texts_of(pa.array(["a b a b", None, "Zz"])))
    assert np.diff(first).tolist() == [5, 1, 2] and (feature[first[:-1]] == 0).all()
    assert (value[1:5] ** 2).sum() == pytest.approx(1)


@pytest.mark.parametrize("limit", [4000, 7])
def test_embedding_dedup(spark, limit):
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((300, 16))
    for k in range(60):
        rows[100 + k] = rows[k % 5] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])
    rows[200:220] = rows[3]
    made = [(i, [float(x) for x in r], i % 3) for i, r in enumerate(rows)]
    made += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, [float("inf")] * 16, 0), (305, [1e300] * 16, 0), (306, [2e300] * 16, 1), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [], 0)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").repartition(3)
    with np.errstate(all="ignore"):
        unit = {i: np.array(v) / max(np.abs(v)) for i, v, _ in made if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    want, degree = components(links, [m[0] for m in made]), Counter(x for pair in links for x in pair)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, leaf_limit=limit).collect()}
    assert len(got) == len(made)
    found = sum(r.n_links for r in got.values())
    assert found <= 2 * len(links) and found >= 0.98 * 2 * len(links)
    assert sum(got[i].component_id == want[i] for i in want) >= len(want) - 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and all(got[i].n_links == 0 for i in (300, 301, 302, 303, 304, 309))
    assert got[305].component_id == got[306].component_id == 305
    if limit > 100:
        assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("sample", [20_000, 500])
def test_a_deep_forest_finds_the_links(spark, monkeypatch, sample):
    """20,000 vectors, a tenth of them near one of the others: leaves stay small, recall is 0.9 or more and no link is below the threshold; with a
    small sample the lower levels are split in the table."""
    monkeypatch.setattr(embedding_dedup, "SAMPLE", sample)
    rng = np.random.default_rng(3)
    n, d = 20_000, 24
    rows = rng.standard_normal((n, d))
    for i in range(0, n, 10):
        rows[i + 1] = rows[i] + rng.standard_normal(d) * rng.choice([0.05, 0.2, 0.35])
    rows[500:900] = rows[500] + rng.standard_normal((400, d)) * 0.1
    unit = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
    degree = np.concatenate([(unit[i : i + 2000] @ unit.T >= 0.9).sum(1) - 1 for i in range(0, n, 2000)])
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(np.arange(0, n * d + 1, d, dtype=np.int32), rows.ravel())})
    got = embedding_dedup.near_duplicates(spark.createDataFrame(table).repartition(8), leaf_limit=300).toPandas().set_index("vec_id").sort_index()
    found = got["n_links"].to_numpy()
    assert (found <= degree).all() and found.sum() >= 0.95 * degree.sum() and degree.sum() > 100_000
    assert (got.loc[500:899, "component_id"] == got.loc[500, "component_id"]).all()


def test_pipeline_stages_keep_columns_and_drop_what_they_reject(spark, tmp_path):
    import corpus_pipeline

    good, other = _speech(5, ["an", "de", "ro"], 80), _speech(6, ["sti", "ner", "vau"], 80)
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate([(t, "xx") for t in good] + [(t, "yy") for t in other])]
    rows += [(160, good[0], "xx", "s", 5), (161, None, None, None, None), (162, "", "xx", "s", 0)]
    clash = ["ref", "removed_spans", "score", "predicted", "lang_pred", "margin", "accepted", "held_out", "row", "spans", "n_removed", "kept", "t1", "part"]
    df = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in clash)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(160)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r.doc_id for r in docs.collect()}
    assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in clash)
    twice = spark.createDataFrame([(1, "one two"), (1, "six seven"), (1, "one two"), (None, "x y"), (None, "x y")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_copies(spark, twice, "").collect()) == [0, 0, 1]
    assert 160 not in ids and 161 not in ids and 0 in ids and len(ids) >= 150
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
