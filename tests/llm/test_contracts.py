"""Columns of any name, words whose sums of powers are equal, and code points that programs take differently."""

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from hairpin.llm import bpe, jaccard_join, language_id, quality_classifier, quality_rules, suffix_dedup  # noqa: E402
from hairpin.llm.batches import BASE, OTHER_BASE, prefix_hash, range_hash, span_hashes, texts_of  # noqa: E402

WORD = str(public_tokenizers.path("word_bpe_49k.json"))


def thue_morse(n):
    return ["".join("ab"[(i.bit_count() + k) % 2] for i in range(n)) for k in range(2)]


def test_columns_of_any_name(spark):
    names = ["my col", "a.b", "a:b", "`tick`", "q_words", "q_lines", "n.ested", "row", "kept x"]
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * 9, "en", *([i] * len(names))) for i in range(6)]).toDF("doc_id", "text", "lang", *names)
    weights = np.zeros(1 << quality_classifier.BITS, np.float32)
    for out in (quality_classifier.score(docs, weights), language_id.identify(docs), suffix_dedup.remove(docs, as_text=True), bpe.encode(docs, WORD), quality_rules.annotate(docs)):
        rows = out.collect()
        assert len(rows) == 6 and all([r[n] for n in names] == [r["doc_id"]] * len(names) for r in rows)
    assert jaccard_join.components(docs).count() == 6


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_collide_in_sums_of_powers(spark, n):
    a, b = thue_morse(n)
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    start, end = np.array([0, n + 1]), np.array([n, 2 * n + 1])
    for base in (BASE, OTHER_BASE):
        assert len(set(range_hash(prefix_hash(data, base), start, end, base).tolist())) == 1
        assert len(set(span_hashes(data, start, end, base).tolist())) == 2
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    coder = bpe.WordCoder(bpe.Vocabulary(WORD))
    ids, first = coder.encode(texts_of(pa.array([a, b, a])))
    for i, text in enumerate((a, b, a)):
        assert ids[first[i] : first[i + 1]].tolist() == coder.library.encode(text, add_special_tokens=False).ids
    # neither text is removed for the other
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove(docs).collect()}
    want = {}
    for d, text in ((1, a), (2, b), (3, a)):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 199):
            s = text[i : i + 200]
            if sum(x.count(s) + (x.find(s, x.find(s) + 1) >= 0) for x in (a, b, a)) > 1:
                gone[i : i + 200] = True
        want[d] = int(gone.sum())
    assert got == want


def test_code_points_equal_the_library():
    coder = bpe.WordCoder(bpe.Vocabulary(WORD))
    # all but most of the large uniform blocks, in which every code point is alike
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xD700 <= c < 0x20000 or c % 97 == 0 or 0x323A0 <= c < 0x33500 or 0xE0000 <= c < 0xE0200)]
    points = [c for c in points if not 0xE000 <= c < 0xF900 or c % 97 == 0]
    for at in range(0, len(points), 4096):
        texts = [f"a{chr(c)}{chr(c)}b" for c in points[at : at + 4096]]
        ids, first = coder.encode(texts_of(pa.array(texts)))
        for i, known in enumerate(coder.library.encode_batch(texts, add_special_tokens=False)):
            assert ids[first[i] : first[i + 1]].tolist() == known.ids, hex(points[at + i])


def test_mixed_words_equal_the_library():
    rng, odd = np.random.default_rng(3), ["՘", "౜", "Ᲊ", "Ɤ", "\U00010d50", "\U00018d80"]
    coder = bpe.WordCoder(bpe.Vocabulary(WORD))
    texts = ["".join(rng.choice([*"aB1. é\n", *odd, "Σ", "é", "<|endoftext|>", " "]) for _ in range(rng.integers(0, 40))) for _ in range(400)]
    ids, first = coder.encode(texts_of(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == coder.library.encode(text, add_special_tokens=False).ids, text
